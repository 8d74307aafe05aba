"""Connected components of links that stay in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import saved

ROWS_PER_TASK = 200_000  # links a task handles; fewer, larger tasks than shuffle partitions while links are few


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of the links; root is the smallest node of its component.

    Large-star and small-star steps in turn: each node hands its neighbours the smallest
    node it knows, until the links are stars around the smallest. Every step is a
    grouped minimum and a join, written before the next; a node with very many
    neighbours is a skewed join that adaptive execution splits.
    """
    edges = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links")
    # A step never has more links than twice those it began with.
    tasks = 2 * edges.count() // ROWS_PER_TASK + 1

    def packed(df: DataFrame) -> DataFrame:
        return df.coalesce(tasks)

    while True:
        # Done when every node above another is so once and is below none: then the links are stars.
        sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
        sides = packed(sides.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below")))
        if sides.where("above > 1 or (above = 1 and below = 1)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = packed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(packed(large.where("u != v").distinct()), "links")  # read twice below
        least = packed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = saved(packed(small), "links")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
