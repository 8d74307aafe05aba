"""Correlation and group tests, each family in one pass over the table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.distributions import f_p_value, t_p_value
from ..ordering import Lookup, lookup_join, running_sums
from ..schema import numeric_columns, present, quoted, string_columns
from ..session import shared_path
from .profile import pick_grouping_column, rows_from_aggregates

SIGNIFICANCE = 0.05

CORRELATION_SCHEMA = ("test_type string, variable1 string, variable2 string, n bigint, correlation double, "
                      "p_value double, significant boolean, effect_size double")


def column_pairs(df: DataFrame) -> DataFrame:
    """Numeric columns i < j with the number of rows present in both."""
    both = [[F.lit(a), F.lit(b), F.count_if(present(df, a).isNotNull() & present(df, b).isNotNull())]
            for a, b in combinations(numeric_columns(df), 2)]
    if not both:
        return df.sparkSession.createDataFrame([], "variable1 string, variable2 string, n bigint")
    return rows_from_aggregates(df, both, ["variable1", "variable2", "n"])


def num_by_cat_grid(df: DataFrame) -> DataFrame:
    """Numeric by category columns with the number of rows present in both."""
    both = [[F.lit(n), F.lit(c), F.count_if(present(df, n).isNotNull() & quoted(c).isNotNull())]
            for n in numeric_columns(df) for c in string_columns(df)]
    if not both:
        return df.sparkSession.createDataFrame([], "dependent_variable string, independent_variable string, n bigint")
    return rows_from_aggregates(df, both, ["dependent_variable", "independent_variable", "n"])


def _sums(df: DataFrame, width: int, pairs: list[tuple[int, int]], places: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``pair, n, xy, x, y, xx, yy``: sums over the rows in which both sides of a pair are there.

    ``df`` has one column ``values``, an array of ``width`` numbers or nulls. Side x of pair k is
    the number at ``places[0][k]``, side y that at ``places[1][k]``. Each task adds up all pairs
    in one pass over its rows, as matrix products where the sides are whole columns, and sends
    a row per pair.
    """
    left, right = places
    square = np.array_equal(left, [a for a, _ in pairs]) and np.array_equal(right, [b for _, b in pairs])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(pairs)))
        grams = np.zeros((4, width, width)) if square else None
        size = max(1, 1 << 22 >> max(width if square else len(pairs), 1).bit_length())
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = flat.reshape(-1, width)
            for start in range(0, len(rows), size):
                part = rows[start:start + size]
                if square:
                    there = (~np.isnan(part)).astype(np.float64)
                    held = np.where(there > 0, part, 0.0)
                    grams[0] += there.T @ there
                    grams[1] += held.T @ held
                    grams[2] += held.T @ there
                    grams[3] += (held * held).T @ there
                else:
                    x, y = part[:, left], part[:, right]
                    there = ~(np.isnan(x) | np.isnan(y))
                    x, y = np.where(there, x, 0.0), np.where(there, y, 0.0)
                    total += np.array([there.sum(0), (x * y).sum(0), x.sum(0), y.sum(0), (x * x).sum(0), (y * y).sum(0)])
        if square:
            total = np.array([grams[0][left, right], grams[1][left, right], grams[2][left, right], grams[2][right, left],
                              grams[3][left, right], grams[3][right, left]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs), dtype=np.int32)), *[pa.array(t) for t in total]],
                                         ["pair", "n", "xy", "x", "y", "xx", "yy"])

    sums = ["n", "xy", "x", "y", "xx", "yy"]
    parts = df.select("values").mapInArrow(task, "pair int, " + ", ".join(f"{s} double" for s in sums))
    return parts.groupBy("pair").agg(*[F.sum(s).alias(s) for s in sums])


def _correlations(sums: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """``variable1, variable2, n, correlation`` from the sums of each pair; null where a side does not vary."""
    n = F.col("n")
    spread_x = F.greatest(F.col("xx") - F.try_divide(F.col("x") * F.col("x"), n), F.lit(0.0))
    spread_y = F.greatest(F.col("yy") - F.try_divide(F.col("y") * F.col("y"), n), F.lit(0.0))
    joint = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), n)
    r = F.try_divide(joint, F.sqrt(spread_x) * F.sqrt(spread_y))
    # least and greatest pass over nulls and sort NaN last, so an undefined r (a column holds an infinity) is kept apart.
    bounded = F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    named = sums.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(names)], "pair int, variable1 string, variable2 string")
    return named.join(sums, "pair", "left").select(
        "variable1", "variable2", F.coalesce(n, F.lit(0)).cast("bigint").alias("n"), bounded.alias("correlation"))


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, diagonal: bool = False) -> DataFrame:
    """``(variable1, variable2, n, correlation)`` of all column pairs over the rows where both are present.

    A first pass finds each column's mean. The second sums products of the centred values
    for all pairs at once, whatever the number of columns. A constant side gives null, and
    so does one that holds an infinity.
    """
    columns = numeric_columns(df) if columns is None else columns
    places = [(i, j) for i in range(len(columns)) for j in range(i + (not diagonal), len(columns))]
    if not places:
        return df.sparkSession.createDataFrame([], "variable1 string, variable2 string, n bigint, correlation double")
    values = [present(df, c).cast("double") for c in columns]
    means = df.agg(*[F.avg(v) for v in values]).first()
    # A mean that is not finite stays in: the column's sums are then undefined.
    centred = df.select(F.array(*[v - F.lit(0.0 if m is None else float(m)) for v, m in zip(values, means)]).alias("values"))
    endless = [F.lit(m is not None and not math.isfinite(m)) for m in means]
    centred = centred.select(F.transform("values", lambda v, i: F.when(F.get(F.array(*endless), i) & v.isNotNull(), 0.0).otherwise(v))
                             .alias("values")) if any(m is not None and not math.isfinite(m) for m in means) else centred
    sides = np.array(places).T
    return _correlations(_sums(centred, len(columns), places, (sides[0], sides[1])), [(columns[i], columns[j]) for i, j in places])


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The full matrix in long form: both triangles and the diagonal; empty below two columns."""
    names = numeric_columns(df) if columns is None else columns
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "variable1 string, variable2 string, correlation double")
    half = correlation_pairs(df, names, diagonal=True)
    # 1 where the column varies: its correlation with itself is defined then.
    same = F.col("variable1") == F.col("variable2")
    sides = F.array(F.struct("variable1", "variable2"), F.struct(F.col("variable2").alias("variable1"), F.col("variable1").alias("variable2")))
    cells = half.select(F.explode(F.slice(sides, 1, F.when(same, 1).otherwise(2))).alias("cell"),
                        F.when(same & F.col("correlation").isNotNull(), 1.0).otherwise(F.col("correlation")).alias("correlation"))
    return cells.select("cell.variable1", "cell.variable2", "correlation")


def correlation_wide(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column, one field per column."""
    names = numeric_columns(df) if columns is None else columns
    return correlation_matrix(df, names).groupBy("variable1").pivot("variable2", names).agg(F.first("correlation"))


def high_corr_pairs(df: DataFrame, limit: float = 0.8) -> DataFrame:
    return correlation_pairs(df).where(F.abs("correlation") > limit).select("variable1", "variable2", "correlation")


def _tested(pairs: DataFrame, kind: str) -> DataFrame:
    """Significance of correlations over at least three pairs."""
    r, n = F.col("correlation"), F.col("n")
    exact = F.abs(r) >= 1.0
    t = F.try_divide(r * F.sqrt(n - 2), F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))
    # Two points always lie on a line; with three or more, |r| = 1 has p = 0.
    scored = pairs.where(n >= 3).where(r.isNotNull()).withColumn(
        "p_value", F.when(exact, F.lit(0.0)).otherwise(t_p_value(t, n - 2)))
    return scored.select(
        F.lit(kind).alias("test_type"), "variable1", "variable2", "n", "correlation", "p_value",
        (F.col("p_value") < SIGNIFICANCE).alias("significant"), F.abs(r).alias("effect_size"),
    )


def pearson_test(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _tested(correlation_pairs(df, columns), "pearson_correlation")


def ranked_rows(df: DataFrame, columns: list[str], keep: list[str], gaps: list[int]) -> tuple[DataFrame, list[list[int]]]:
    """Every row with the tie-averaged ranks of all its columns, from one sort whatever the number of columns.

    Gives ``_row``, the kept columns and ``ranks``: per column an array, null where the value is
    missing. The first rank is among all values of the column, the next ones, per column of ``gaps`` (places in
    ``columns``), among the rows that have that column too. Also gives how many rows each
    of these rankings has, per column.

    Values become rows (column, value); the distinct ones, with the numbers of rows behind
    them, are range-sorted once. A rank is what stands before in the order, and leaving
    rows out of a ranking takes off how many of them stand before. One join brings ranks back
    to the values, one grouping back to the rows.
    """
    spark = df.sparkSession
    path = shared_path(spark, "values-to-rank")
    held = [quoted(c).alias(f"k{i}") for i, c in enumerate(keep)]
    numbers = [present(df, c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    df.select(*held, *numbers).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    base = spark.read.parquet(path)  # written, so that a row's number is the same in every use
    long = base.select("_row", F.array(*[F.col(f"v{g}").isNull().cast("long") for g in gaps]).alias("lost") if gaps
                       else F.array().cast("array<bigint>").alias("lost"),
                       F.posexplode(F.array(*[f"v{i}" for i in range(len(columns))])).alias("column", "value")).where("value is not null")
    # -0.0 and 0.0 are one value, as they are in comparisons.
    long = long.withColumn("value", F.col("value") + F.lit(0.0))
    counts = long.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.get("lost", F.lit(k))).alias(f"l{k}") for k in range(len(gaps))])
    sums = ["n", *[f"l{k}" for k in range(len(gaps))]]
    placed, totals = running_sums(counts, [F.col("column"), F.col("value")], sums, "column")
    own = F.col("_n") + (F.col("n") + 1) / 2
    among = [F.col("_n") - F.col(f"_l{k}") + (F.col("n") - F.col(f"l{k}") + 1) / 2 for k in range(len(gaps))]
    table = placed.select(F.struct("column", "value").alias("at"), "n", F.array(own, *among).alias("ranks"))
    sizes = {row["column"]: [row["n"], *[row["n"] - row[f"l{k}"] for k in range(len(gaps))]] for row in totals}
    lookup = Lookup(table, sum(row["rows"] for row in totals), sum(row["n"] for row in totals))
    ranked = lookup_join(long.select("_row", "column", "value"), lookup, F.struct("column", "value"), "at", ["ranks"])
    # A row of its own per input row keeps rows without any value.
    whole = base.select("_row", *[f"k{i}" for i in range(len(keep))], F.lit(None).cast("int").alias("column"),
                        F.lit(None).cast("array<double>").alias("ranks"), F.lit(True).alias("first"))
    both = ranked.select("_row", "column", "ranks").unionByName(whole, allowMissingColumns=True)
    gathered = both.groupBy("_row").agg(
        *[F.max(F.when(F.col("first"), F.struct(f"k{i}")))[f"k{i}"].alias(keep[i]) for i in range(len(keep))],
        F.map_from_entries(F.collect_list(F.when(F.col("column").isNotNull(), F.struct("column", "ranks")))).alias("_ranks"))
    ordered = F.array(*[F.try_element_at("_ranks", F.lit(i)) for i in range(len(columns))])
    return gathered.withColumn("ranks", ordered).drop("_ranks"), [
        sizes.get(i, [0] * (1 + len(gaps))) for i in range(len(columns))]


def rank_columns(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Replace columns by their tie-averaged ranks, beside the kept columns; nulls keep no rank."""
    keep = keep or []
    ranked, _ = ranked_rows(df, columns, keep, [])
    return ranked.select(*[quoted(c) for c in keep],
                         *[F.get(F.get("ranks", F.lit(i)), F.lit(0)).alias(c) for i, c in enumerate(columns)])


def average_rank(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Tie-averaged rank of one column beside the kept columns."""
    ranked = rank_columns(df.select(*[quoted(c) for c in keep], quoted(column).alias("_value")), ["_value"], keep)
    return ranked.withColumnRenamed("_value", "rank")


def spearman_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson on average ranks, each pair ranked over the rows where both are present."""
    columns = numeric_columns(df) if columns is None else columns
    pairs = list(combinations(range(len(columns)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "variable1 string, variable2 string, n bigint, correlation double")
    missing = df.agg(*[F.count_if(present(df, c).isNull()) for c in columns]).first()
    gaps = [i for i, m in enumerate(missing) if m]
    ranked, sizes = ranked_rows(df, columns, [], gaps)
    width = 1 + len(gaps)
    # Ranks of n rows average (n + 1) / 2, which centres each ranking exactly.
    middles = F.array(*[F.array(*[F.lit((n + 1) / 2) for n in column]) for column in sizes])
    centred = F.transform("ranks", lambda r, i: F.coalesce(
        F.transform(r, lambda value, k: value - F.get(F.get(middles, i), k)), F.array_repeat(F.lit(None).cast("double"), width)))
    rows = ranked.select(F.flatten(centred).alias("values"))
    # Side x of a pair is its first column ranked among the rows that have the second.
    among = {g: 1 + k for k, g in enumerate(gaps)}
    left = np.array([i * width + among.get(j, 0) for i, j in pairs])
    right = np.array([j * width + among.get(i, 0) for i, j in pairs])
    return _correlations(_sums(rows, len(columns) * width, pairs, (left, right)), [(columns[i], columns[j]) for i, j in pairs])


def spearman_test(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _tested(spearman_pairs(df, columns), "spearman_correlation")


def group_moments(df: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """``(dependent_variable, independent_variable, category, n, mean, var)`` of every grid cell.

    Each row expands once per category column, however many these are; partial
    aggregation leaves one row per category and task to shuffle. Its moments are mergeable.
    """
    groups = F.array(*[F.struct(F.lit(c).alias("independent_variable"), quoted(c).cast("string").alias("category")) for c in categories])
    source = df.select(F.explode(groups).alias("_g"), *[present(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(numeric)])
    moments = [
        F.struct(F.lit(c).alias("dependent_variable"), F.count(f"x{i}").alias("n"), F.avg(f"x{i}").alias("mean"),
                 F.var_samp(f"x{i}").alias("var")).alias(f"m{i}")
        for i, c in enumerate(numeric)
    ]
    grouped = source.where("_g.category is not null").groupBy("_g.independent_variable", "_g.category").agg(*moments)
    return grouped.select("independent_variable", "category", F.inline(F.array(*[F.col(f"m{i}") for i in range(len(numeric))]))).where(
        "independent_variable <> dependent_variable")


def group_size_filter(moments: DataFrame) -> DataFrame:
    """Groups of more than one row."""
    return moments.where("n > 1")


def _grid(df: DataFrame, numeric: list[str] | None, categories: list[str] | None) -> DataFrame | None:
    numeric = numeric_columns(df) if numeric is None else numeric
    categories = string_columns(df) if categories is None else categories
    if not categories:
        fallback = pick_grouping_column(df)
        categories = [fallback] if fallback else []
    if not numeric or not categories:
        return None
    return group_size_filter(group_moments(df, numeric, categories))


def _group_tests(df: DataFrame, numeric: list[str] | None, categories: list[str] | None) -> DataFrame | None:
    groups = _grid(df, numeric, categories)
    if groups is None:
        return None
    test = ["dependent_variable", "independent_variable"]
    totals = groups.groupBy(*test).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("total"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("grand"))
    # One row per test: columns times columns, so it is small whatever the table holds.
    deviations = groups.join(F.broadcast(totals.select(*test, "grand")), test).groupBy(*test).agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
        F.min_by("mean", "category").alias("first_mean"), F.max_by("mean", "category").alias("second_mean"),
        F.min_by("n", "category").alias("first_n"), F.max_by("n", "category").alias("second_n"))
    return totals.join(deviations, test).where("groups >= 2")


_GROUP_COLUMNS = ["test_type", "dependent_variable", "independent_variable", "groups", "f_statistic", "t_statistic",
                  "p_value", "significant"]
_GROUP_SCHEMA = ("test_type string, dependent_variable string, independent_variable string, groups bigint, "
                 "f_statistic double, t_statistic double, p_value double, significant boolean")


def _shape(tests: DataFrame) -> DataFrame:
    return tests.withColumn("significant", F.col("p_value") < SIGNIFICANCE).select(*_GROUP_COLUMNS)


def anova_oneway(df: DataFrame, numeric: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """F test of every numeric column over every category column with two or more groups."""
    tests = _group_tests(df, numeric, categories)
    if tests is None:
        return df.sparkSession.createDataFrame([], _GROUP_SCHEMA)
    df1, df2 = F.col("groups") - 1, F.col("total") - F.col("groups")
    f = F.when((F.col("within") == 0) & (F.col("between") > 0), F.lit(float("inf"))).otherwise(
        F.try_divide(F.col("between") / df1, F.try_divide(F.col("within"), df2)))
    return _shape(tests.select(
        F.lit("anova").alias("test_type"), "dependent_variable", "independent_variable", "groups",
        f.alias("f_statistic"), F.lit(None).cast("double").alias("t_statistic"), df1.alias("df1"), df2.alias("df2"),
    ).withColumn("p_value", f_p_value(F.col("f_statistic"), F.col("df1"), F.col("df2"))))


def t_test_ind(df: DataFrame, numeric: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """Pooled-variance t, first sorted group minus second, where exactly two groups exist."""
    tests = _group_tests(df, numeric, categories)
    if tests is None:
        return df.sparkSession.createDataFrame([], _GROUP_SCHEMA)
    free = F.col("total") - 2
    pooled = F.col("within") / free
    error = F.sqrt(pooled * (1 / F.col("first_n") + 1 / F.col("second_n")))
    gap = F.col("first_mean") - F.col("second_mean")
    t = F.when((error == 0) & (gap != 0), F.signum(gap) * F.lit(float("inf"))).otherwise(F.try_divide(gap, error))
    return _shape(tests.where("groups = 2").select(
        F.lit("t_test").alias("test_type"), "dependent_variable", "independent_variable", "groups",
        F.lit(None).cast("double").alias("f_statistic"), t.alias("t_statistic"), free.alias("free"),
    ).withColumn("p_value", F.when(F.abs("t_statistic") == float("inf"), 0.0).otherwise(
        t_p_value(F.col("t_statistic"), F.col("free")))))


def union_tests(*tests: DataFrame) -> DataFrame:
    """All tests in one table; fields a kind lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tests)


def significant_only(tests: DataFrame) -> DataFrame:
    return tests.where(F.col("p_value") < SIGNIFICANCE)


def stat_summary(tests: DataFrame) -> DataFrame:
    """Tests run, by kind, significant, and the significant share."""
    correlation = F.col("test_type").isin("pearson_correlation", "spearman_correlation")
    counted = tests.agg(
        F.count(F.lit(1)).alias("total_tests"), F.count_if(correlation).alias("correlation_tests"),
        F.count_if(~correlation).alias("hypothesis_tests"),
        F.count_if(F.coalesce(F.col("significant"), F.lit(False))).alias("significant_tests"))
    return counted.withColumn(
        "significance_rate", F.coalesce(F.try_divide(F.col("significant_tests"), F.col("total_tests")), F.lit(0.0)))
