"""Profiling: shape, missing values, distinct counts, describe, frequent values.

Every operator is one pass over the table. Aggregates that fit one global
``agg`` never shuffle values; distinct values are counted by regrouping the
unpivoted ``(column, value)`` pairs, so map-side aggregation absorbs hot values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..quantiles import exact_quantiles
from ..schema import columns_of, family, nan_to_null, numeric_columns, present, quoted, schema_table, string_columns


def rows_from_aggregates(df: DataFrame, entries: list[list[Column]], names: list[str]) -> DataFrame:
    """One global aggregate turned into rows: an entry of columns per row."""
    if not entries:
        raise ValueError("nothing to aggregate")
    aggregates = [c.alias(f"a{i}_{j}") for i, row in enumerate(entries) for j, c in enumerate(row)]
    wide = df.agg(*aggregates)
    structs = [
        F.struct(*[F.col(f"a{i}_{j}").alias(n) for j, n in enumerate(names)]) for i in range(len(entries))
    ]
    return wide.select(F.inline(F.array(*structs)))


def _text(df: DataFrame, name: str) -> Column:
    """Values as text; 0.0 and -0.0 are one value, NaN is missing."""
    column = present(df, name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        column = column + F.lit(0.0)
    return column.cast("string")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, n)`` of every column at once, values as text."""
    columns = df.columns if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    texts = df.select(*[_text(df, c).alias(c) for c in columns])
    long = texts.unpivot([], [quoted(c) for c in columns], "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, rows, n_missing, n_distinct)``, exact.

    Columns are regrouped with others of their kind, so that whole numbers and
    floats are hashed as such and only the remaining kinds are turned to text.
    Each branch reads its own columns alone.
    """
    columns = df.columns if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, rows bigint, n_missing bigint, n_distinct bigint")

    def kind(name: str) -> str:
        dtype = df.schema[name].dataType
        if isinstance(dtype, T.IntegralType):
            return "bigint"
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return "double"
        return "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "string"

    parts = []
    for wanted in ("bigint", "double", "timestamp_ntz", "string"):
        some = [c for c in columns if kind(c) == wanted]
        if not some:
            continue
        # A float that is not missing has 0.0 and -0.0 as one value already: grouping normalises them.
        typed = df.select(*[present(df, c).cast(wanted).alias(c) for c in some])
        long = typed.unpivot([], [quoted(c) for c in some], "column", "value")
        groups = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        parts.append(groups.groupBy("column").agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
            F.count("value").alias("n_distinct")))
    return reduce(DataFrame.unionByName, parts)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that equal an earlier row, nulls being equal to nulls."""
    whole = nan_to_null(df).toDF(*[f"c{i}" for i in range(len(df.columns))])
    groups = whole.groupBy(*whole.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values per column."""
    entries = [[F.lit(c), F.count_if(present(df, c).isNull())] for c in df.columns]
    return rows_from_aggregates(df, entries, ["column", "n_missing"])


def missing_only(df: DataFrame) -> DataFrame:
    return missing_counts(df).where("n_missing > 0")


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, missing count and share, distinct count per column.

    The exact form shuffles the distinct values of each column;
    ``approximate`` uses sketches in a single pass without a shuffle.
    """
    if approximate:
        entries = [[F.lit(c), F.count(F.lit(1)), F.count_if(present(df, c).isNull()),
                    F.approx_count_distinct(present(df, c))] for c in df.columns]
        counted = rows_from_aggregates(df, entries, ["column", "rows", "n_missing", "n_distinct"])
    else:
        counted = distinct_counts(df)
    types = F.create_map(*[e for f in df.schema.fields for e in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return counted.select(
        "column", F.element_at(types, F.col("column")).alias("dtype"), "n_missing",
        (F.col("n_missing") * 100.0 / F.col("rows")).alias("missing_pct"), "n_distinct",
    )


def numeric_describe(df: DataFrame) -> DataFrame:
    """count, mean, std (sample), min, quartiles, max per numeric column."""
    columns = numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n bigint, mean double, std double, min double, "
                                                   "p25 double, p50 double, p75 double, max double")
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    entries = []
    for c in columns:
        value = present(df, c).cast("double")
        entries.append([F.lit(c), F.count(value), F.avg(value), F.stddev_samp(value), F.min(value),
                        *[F.lit(q).cast("double") for q in quartiles[c]], F.max(value)])
    return rows_from_aggregates(df, entries, ["column", "n", "mean", "std", "min", "p25", "p50", "p75", "max"])


def numeric_minmax(df: DataFrame) -> DataFrame:
    return numeric_describe(df).select("column", "min", "max", "mean", F.col("p50").alias("median"), "std")


def top_values(df: DataFrame, k: int = 5, columns: list[str] | None = None) -> DataFrame:
    """The k most frequent values of each string column, smallest value first on ties.

    The rank filter is applied before the shuffle as well (window group limit),
    so a column with very many values sends at most k of them per task.
    """
    counts = value_counts(df, string_columns(df) if columns is None else columns).where("value is not null")
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("column", "rank", "value", "n", (F.col("rank") == 1).alias("most_common"))


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value of each column as text, smallest on ties; one row per column reaches the driver."""
    best = (
        value_counts(df, columns).where("value is not null").groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("best"))
    )
    found = {r["column"]: r["value"] for r in best.select("column", "best.value").collect()}
    return {c: found.get(c) for c in columns}


def datetime_range(df: DataFrame) -> DataFrame:
    entries = [[F.lit(c), F.min(quoted(c)).cast("timestamp_ntz"), F.max(quoted(c)).cast("timestamp_ntz")]
               for c in columns_of(df, "datetime")]
    if not entries:
        return df.sparkSession.createDataFrame([], "column string, min_date timestamp_ntz, max_date timestamp_ntz")
    return rows_from_aggregates(df, entries, ["column", "min_date", "max_date"])


def categorical_cardinality(df: DataFrame) -> DataFrame:
    return distinct_counts(df, string_columns(df)).select("column", "n_distinct")


def small_cardinalities(df: DataFrame, columns: list[str], limit: int) -> dict[str, int | None]:
    """Distinct counts up to ``limit``; ``None`` for columns with more.

    d distinct values set at most d registers of a distinct-count sketch, so an
    estimate above twice the limit proves that a column has more. Only the other
    columns, whose values are few, are counted exactly.
    """
    if not columns:
        return {}
    estimates = df.agg(*[F.approx_count_distinct(present(df, c)).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    few = [c for i, c in enumerate(columns) if estimates[i] <= 2 * limit + 2]
    counts: dict[str, int | None] = dict.fromkeys(columns)
    if few:
        for row in distinct_counts(df, few).collect():
            counts[row["column"]] = row["n_distinct"] if row["n_distinct"] <= limit else None
    return counts


def column_roles(df: DataFrame) -> DataFrame:
    """numeric, binary (string, two values), categorical, datetime or other per column."""
    binary = [c for c, d in small_cardinalities(df, string_columns(df), 2).items() if d == 2]
    role = (
        F.when(F.col("column").isin(binary), "binary").when(F.col("family") == "string", "categorical")
        .when(F.col("family").isin("numeric", "datetime"), F.col("family")).otherwise("other")
    )
    return schema_table(df).select("position", "column", "dtype", role.alias("role"))


def pick_grouping_column(df: DataFrame, low: int = 2, high: int = 10) -> str | None:
    """First column in schema order with ``low`` to ``high`` distinct values."""
    plain = [c for c in df.columns if family(df.schema[c].dataType) != "other"]  # no arrays, maps or structs
    counts = small_cardinalities(df, plain, high)
    return next((c for c in plain if counts[c] is not None and counts[c] >= low), None)


def dtype_families(df: DataFrame) -> DataFrame:
    """Columns per family, the distinct types among them, and their missing values."""
    named = schema_table(df).join(F.broadcast(missing_counts(df)), "column")
    return named.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_columns"), F.concat_ws(", ", F.array_sort(F.collect_set("dtype"))).alias("dtypes"),
        F.sum("n_missing").alias("n_missing"))


def sample_rows(df: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """First k rows in the given order, with the table's row count."""
    total = df.count()
    return df.orderBy(*[quoted(o) for o in order]).limit(k).withColumn("total_rows", F.lit(total).cast("bigint"))


def sample_values(df: DataFrame, order: str, k: int = 3) -> DataFrame:
    """First k present values of each column in the order of a unique column."""
    texts = df.select(quoted(order).alias("_order"), *[_text(df, c).alias(c) for c in df.columns])
    long = texts.unpivot(["_order"], [quoted(c) for c in df.columns], "column", "value").where("value is not null")
    place = Window.partitionBy("column").orderBy("_order")
    return (
        long.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
        .select("column", "place", "value")
    )


def required_fields_valid(df: DataFrame, required: list[str]) -> DataFrame:
    """Required columns that are absent, and rows with a missing required value."""
    absent = [c for c in required if c not in df.columns]
    held = [c for c in required if c in df.columns]
    bad = F.lit(False)
    for c in held:
        bad = bad | present(df, c).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("failing_rows")).select(
        F.lit(", ".join(absent)).alias("absent"), "n_rows", "failing_rows",
        (F.lit(not absent) & (F.col("failing_rows") == 0)).alias("valid"),
    )
