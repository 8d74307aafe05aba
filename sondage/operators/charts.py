"""The small series behind each chart, aggregated from the raw table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..quantiles import exact_quantiles
from ..schema import numeric_columns, present, quoted
from .models import model_score
from .profile import rows_from_aggregates

HISTOGRAM_COLUMNS = 4
HISTOGRAM_BINS = 30
SCORE_BINS = 10


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(column, bin, lower, upper, n)`` of the first four numeric columns; the last bin is closed.

    One aggregate finds the ranges; the counts are combined on the map side, so
    only bins are shuffled. Empty bins have no row. Infinite values lie in no bin,
    as missing ones do, and do not stretch the range.
    """
    columns = numeric_columns(df)[:HISTOGRAM_COLUMNS] if columns is None else columns
    none = df.sparkSession.createDataFrame([], "column string, bin int, lower double, upper double, n bigint")
    if not columns:
        return none
    numbers = {c: present(df, c).cast("double") for c in columns}
    values = {c: F.when(F.abs(v) != float("inf"), v) for c, v in numbers.items()}
    ends = df.agg(*[e for c in columns for e in (F.min(values[c]), F.max(values[c]))]).first()
    bins_of, starts, widths = [], [], []
    for i, c in enumerate(columns):
        low, high = ends[2 * i], ends[2 * i + 1]
        if low is None:
            continue
        if low == high:  # a constant column gets a range of width one around it
            low, high = low - 0.5, high + 0.5
        place = F.least(F.floor((values[c] - low) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")
        bins_of.append(F.when(values[c].isNotNull(), place).alias(c))  # least() passes over nulls
        starts += [F.lit(c), F.lit(low)]
        widths += [F.lit(c), F.lit((high - low) / bins)]
    if not bins_of:
        return none
    placed = df.select(*bins_of)
    long = placed.unpivot([], [quoted(c) for c in placed.columns], "column", "bin").where("bin is not null")
    counted = long.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    start = F.element_at(F.create_map(*starts), F.col("column"))
    width = F.element_at(F.create_map(*widths), F.col("column"))
    return counted.select("column", "bin", (start + F.col("bin") * width).alias("lower"),
                          (start + (F.col("bin") + 1) * width).alias("upper"), "n")


def box_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR) and outlier count per numeric column."""
    columns = numeric_columns(df)[:HISTOGRAM_COLUMNS] if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, q1 double, median double, q3 double, "
                                                   "whisker_low double, whisker_high double, n_outliers bigint")
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    entries = []
    for c in columns:
        q1, q2, q3 = quartiles[c]
        value = present(df, c).cast("double")
        reach = 1.5 * ((q3 or 0.0) - (q1 or 0.0))
        inside = value.between((q1 or 0.0) - reach, (q3 or 0.0) + reach)
        entries.append([F.lit(c), *[F.lit(q).cast("double") for q in (q1, q2, q3)], F.min(F.when(inside, value)),
                        F.max(F.when(inside, value)), F.count_if(~inside)])
    return rows_from_aggregates(df, entries, ["column", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"])


def stage_status_bars(results: DataFrame) -> DataFrame:
    """1 or 0 per stage, with its display name."""
    return results.select(
        "stage", F.initcap(F.replace("stage", F.lit("_"), F.lit(" "))).alias("label"),
        F.when(F.col("status").isNotNull() & (F.col("status") != "failed"), 1).otherwise(0).alias("bar"))


def _shares(counts: DataFrame, parts: list[tuple[str, Column]], total: Column) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("label"), c.alias("n"), F.try_divide(c, total).alias("share"))
                     for n, c in parts])
    return counts.select(F.inline(rows))


def success_failed_share(results: DataFrame) -> DataFrame:
    counts = results.agg(F.count_if(F.col("status") == "success").alias("good"),
                         F.count_if(F.col("status") == "failed").alias("bad"))
    return _shares(counts, [("Successful", F.col("good")), ("Failed", F.col("bad"))], F.col("good") + F.col("bad"))


def significance_share(tests: DataFrame) -> DataFrame:
    counts = tests.agg(F.count(F.lit(1)).alias("total"),
                       F.count_if(F.coalesce(F.col("significant"), F.lit(False))).alias("yes"))
    return _shares(counts, [("Significant", F.col("yes")), ("Non-significant", F.col("total") - F.col("yes"))],
                   F.col("total"))


def score_per_model(metrics: DataFrame, path: str = "file_path", column: str = "metrics") -> DataFrame:
    """Score and the four metric series of each model, 0 where a metric is absent."""
    # The four metric names.
    series = ["accuracy", "precision", "recall", "f1_score"]
    values = F.col(column)
    return metrics.select(path, model_score(values).alias("score"), *[
        F.coalesce(F.try_element_at(values, F.lit(s)), F.lit(0.0)).alias(s) for s in series])


def finding_counts(findings: DataFrame, recommendations: DataFrame, conclusions: DataFrame, key: str = "run_id") -> DataFrame:
    """Counts of findings and recommendations, and how many runs raise each conclusion flag."""
    flags = [c for c in conclusions.columns if c != key]
    rows = rows_from_aggregates(
        conclusions, [[F.lit(f), F.count_if(quoted(f))] for f in flags], ["category", "n"])
    counted = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("category"), "n")
               for name, t in (("Key Findings", findings), ("Recommendations", recommendations))]
    return reduce(DataFrame.unionByName, [*counted, rows])
