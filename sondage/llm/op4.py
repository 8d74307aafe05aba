"""Query of the quality rules."""

from .quality import STOP_WORDS, judge
from .registry import case, table

_STOP = "', '".join(STOP_WORDS)


@case("op4_quality_rules", rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
      g AS (SELECT doc_id, i, row(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
      g2 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
      r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2) GROUP BY 1),
      c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        length(regexp_replace(array_to_string(w, ''), '[\x00-\xFF\x{{152}}\x{{153}}\x{{2000}}-\x{{206F}}\x{{20AC}}]+', '', 'g')) AS n_foreign,
        len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ('{_STOP}'))) AS n_stop,
        length(array_to_string(w, '')) - length(translate(array_to_string(w, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals
        FROM d LEFT JOIN r USING (doc_id)),
      b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / n_words <= 0.25
        AND n_dup_lines / n_lines <= 0.5 AND (n_stop / n_words >= 0.005 OR n_foreign / word_chars >= 0.02) AND n_capitals / word_chars <= 0.4 AS kept FROM b""")
def op4_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
