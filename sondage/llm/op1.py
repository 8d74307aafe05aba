"""Query of the decontamination operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from .decontaminate import find_items, hit_words, is_contaminated
from .registry import case, table


@case("op1_decontamination", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
      b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
      b1 AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
      b2 AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b1),
      win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM b2),
      d1 AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b1) WHERE len(w) >= n),
      d2 AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d1),
      m AS (SELECT doc_id, i, n, item_id FROM d2 JOIN win USING (n, g)),
      h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
      k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)""")
def op1_decontamination(spark, sf_dir):
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = hit_words("spans")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        is_contaminated(n_hit, F.col("n_words")).alias("contaminated"))
