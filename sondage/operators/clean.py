"""Cleaning: duplicates, sparse columns, imputation, type repair.

A statistics pass yields a small plan (which columns to drop, fill values,
casts); the cleaned table is then one lazy projection over the deduplicated
input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.parsing import DATETIME_FORMATS, as_datetime, as_number
from ..quantiles import exact_quantiles
from ..schema import family, nan_to_null, present, quoted, string_columns
from ..session import stored
from .profile import column_modes, rows_from_aggregates

SPARSE_PCT = 50.0


@dataclass
class CleaningPlan:
    """What the statistics pass decided; its size grows with columns, not rows."""

    rows_after_dedup: int = 0
    missing: dict[str, int] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    fills: dict[str, object] = field(default_factory=dict)
    casts: dict[str, str] = field(default_factory=dict)  # column -> "numeric" or a datetime format


def drop_duplicates(df: DataFrame) -> DataFrame:
    return nan_to_null(df).dropDuplicates()


def dedup_keep_first(df: DataFrame, order: str) -> DataFrame:
    """One row per distinct payload, keeping the smallest value of the order column.

    Grouping with ``min`` combines on the map side, so copies of one hot row
    never meet in a single task, as they would in a window.
    """
    payload = [c for c in df.columns if c != order]
    kept = df.groupBy(*[quoted(c) for c in payload]).agg(F.min(quoted(order)).alias(order))
    return kept.select(*[quoted(c) for c in df.columns])


def _text_kind(text: Column) -> Column:
    """0 for a number, i + 1 for a time of the i-th format, -1 for other text, null for null."""
    kind = F.when(text.isNull(), None).when(as_number(text).isNotNull(), 0)
    for i, pattern in enumerate(DATETIME_FORMATS):
        kind = kind.when(as_datetime(text, pattern).isNotNull(), i + 1)
    return kind.otherwise(-1)


def _with_kinds(df: DataFrame, texts: list[str]) -> tuple[DataFrame, list[Column]]:
    """The table with a kind per text column, and aggregates of how many values are not of each kind."""
    marked = df.withColumns({f"_kind{i}": _text_kind(quoted(c)) for i, c in enumerate(texts)}) if texts else df
    kinds = range(len(DATETIME_FORMATS) + 1)
    return marked, [F.array(*[F.count_if(F.col(f"_kind{i}") != k) for k in kinds]) for i in range(len(texts))]


def suggest_types(df: DataFrame) -> DataFrame:
    """numeric, datetime (with its format) or object for every string column, in one pass."""
    texts = string_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, suggested_dtype string, format string")
    marked, bad = _with_kinds(df.select(*[quoted(c) for c in texts]), texts)
    checked = rows_from_aggregates(marked, [[F.lit(c), b] for c, b in zip(texts, bad)], ["column", "bad"])
    formats = F.array(*[F.lit(f) for f in DATETIME_FORMATS])
    first_good = F.array_position(F.slice(F.col("bad"), 2, len(DATETIME_FORMATS)), F.lit(0).cast("bigint"))
    return checked.select(
        "column",
        F.when(F.col("bad")[0] == 0, "numeric").when(first_good > 0, "datetime").otherwise("object").alias("suggested_dtype"),
        F.when((F.col("bad")[0] > 0) & (first_good > 0), F.get(formats, (first_good - 1).cast("int"))).alias("format"),
    )


def cast_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as numbers; what spells no number becomes null."""
    return df.withColumns({c: as_number(quoted(c)) for c in columns})


def cast_datetime(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    return df.withColumns({c: as_datetime(quoted(c), f) for c, f in formats.items()})


def _missing_row(df: DataFrame) -> tuple[int, dict[str, int]]:
    row = df.agg(F.count(F.lit(1)), *[F.count_if(present(df, c).isNull()) for c in df.columns]).first()
    return row[0], {c: row[i + 1] for i, c in enumerate(df.columns)}


def drop_sparse_columns(df: DataFrame, limit_pct: float = SPARSE_PCT) -> DataFrame:
    """Drop the columns that miss more than ``limit_pct`` percent of their values."""
    rows, missing = _missing_row(df)
    sparse = [c for c in df.columns if rows and missing[c] * 100.0 / rows > limit_pct]
    return df.drop(*sparse)


def _fill(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    columns = {}
    for c, value in fills.items():
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.IntegralType):
            dtype = T.DoubleType()  # a median or mean need not be whole
        columns[c] = F.coalesce(present(df, c).cast(dtype), F.lit(value).cast(dtype))
    return df.withColumns(columns) if columns else df


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    medians = exact_quantiles(df, columns, [0.5])
    return _fill(df, {c: medians[c][0] for c in columns if medians[c][0] is not None})


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    modes = column_modes(df, columns)
    return _fill(df, {c: v for c, v in modes.items() if v is not None})


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[F.avg(present(df, c)) for c in columns]).first()
    return _fill(df, {c: row[i] for i, c in enumerate(columns) if row[i] is not None})


def impute_target(df: DataFrame, target: str, task_type: str) -> DataFrame:
    """Mode for classes, mean for numbers."""
    return impute_mode(df, [target]) if task_type == "classification" else impute_mean(df, [target])


def plan_cleaning(deduplicated: DataFrame) -> CleaningPlan:
    """Decide drops, fills and casts from aggregates over the deduplicated rows."""
    plan = CleaningPlan()
    df = deduplicated
    texts = string_columns(df)
    marked, checks = _with_kinds(df, texts)
    row = marked.agg(F.count(F.lit(1)), *[F.count_if(present(df, c).isNull()) for c in df.columns], *checks).first()
    plan.rows_after_dedup = row[0]
    plan.missing = {c: row[i + 1] for i, c in enumerate(df.columns)}
    gaps = [c for c in df.columns if plan.missing[c] > 0]
    plan.dropped = [c for c in gaps if plan.missing[c] * 100.0 / plan.rows_after_dedup > SPARSE_PCT]
    filled = [c for c in gaps if c not in plan.dropped]
    numeric = [c for c in filled if family(df.schema[c].dataType) == "numeric"]
    medians = exact_quantiles(df, numeric, [0.5])
    plan.fills.update({c: medians[c][0] for c in numeric})
    others = [c for c in filled if c not in numeric and plan.missing[c] < plan.rows_after_dedup]
    if others:
        plan.fills.update(column_modes(df, others))
    for c, bad in zip(texts, row[1 + len(df.columns):]):
        if c in plan.dropped:
            continue
        if bad[0] == 0:
            plan.casts[c] = "numeric"
        elif 0 in bad[1:]:
            plan.casts[c] = DATETIME_FORMATS[bad[1:].index(0)]
    return plan


def apply_cleaning(deduplicated: DataFrame, plan: CleaningPlan) -> DataFrame:
    out = _fill(deduplicated.drop(*plan.dropped), plan.fills)
    out = cast_numeric(out, [c for c, k in plan.casts.items() if k == "numeric"])
    return cast_datetime(out, {c: k for c, k in plan.casts.items() if k != "numeric"})


def clean_table(df: DataFrame) -> tuple[DataFrame, CleaningPlan]:
    """Deduplicate, drop sparse columns, impute, re-type. The result is lazy.

    The deduplicated rows are written once in the shared folder, because the statistics
    passes and the output all read them; no executor memory is held.
    """
    deduplicated = stored(drop_duplicates(df), "deduplicated")
    plan = plan_cleaning(deduplicated)
    return apply_cleaning(deduplicated, plan), plan


def cleaning_summary(df: DataFrame, table_id: str = "table") -> DataFrame:
    """Rows in and out, duplicates, missing values handled, types corrected."""
    rows = df.count()
    _, missing = _missing_row(df)
    _, plan = clean_table(df)
    total_missing = sum(missing.values())
    record = (table_id, "success", rows, plan.rows_after_dedup, rows - plan.rows_after_dedup,
              total_missing, len(plan.casts))
    return df.sparkSession.createDataFrame([record], (
        "table_id string, status string, original_rows bigint, cleaned_rows bigint, duplicates_removed bigint, "
        "missing_handled bigint, types_corrected bigint"))


def quality_rollup(summaries: DataFrame) -> DataFrame:
    """Totals over the cleaned tables; the reduction is 0 when no row came in."""
    good = F.col("status") == "success"

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(good, F.col(name))), F.lit(0)).cast("bigint")

    sums = summaries.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(good).alias("successful_files"),
        total("original_rows").alias("total_original_rows"), total("cleaned_rows").alias("total_cleaned_rows"),
        total("duplicates_removed").alias("total_duplicates_removed"),
        total("missing_handled").alias("total_missing_handled"),
        total("types_corrected").alias("total_type_fixes"),
    )
    lost = F.col("total_original_rows") - F.col("total_cleaned_rows")
    return sums.withColumn(
        "reduction_pct", F.coalesce(F.try_divide(lost * 100.0, F.col("total_original_rows")), F.lit(0.0)))


def complete_pairs(df: DataFrame, a: str, b: str, least: int = 3) -> DataFrame:
    """Rows present in both columns, and whether there are enough of them to test."""
    both = present(df, a).isNotNull() & present(df, b).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(both).alias("n_complete")).withColumn(
        "testable", F.col("n_complete") >= least)
