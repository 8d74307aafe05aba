"""Query of the hard-negative mining."""

from pyspark.sql import functions as F

from .hardneg import mine
from .registry import case, table


@case("op12_hard_negatives", """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
      s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
            CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM r a JOIN r b ON a.vec_id != b.vec_id WHERE a.vec_id % 50 = 0),
      p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
      h AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
              AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM h
    WHERE rank <= 3""")
def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), lambda vec_id: vec_id % 50 == 0)
