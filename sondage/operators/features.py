"""Feature engineering: encoding, scaling, ratios, squares, bins."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..ordering import BROADCAST_BYTES, Lookup, lookup_join, running_sums
from ..quantiles import exact_quantiles
from ..schema import numeric_columns, present, quoted, string_columns
from ..session import shared_path
from .profile import column_modes, small_cardinalities


@dataclass
class FeaturePlan:
    """How a table is transformed, and what each new column was made from."""

    numeric: list[str] = field(default_factory=list)
    binary: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    lineage: dict[str, list[str]] = field(default_factory=dict)


def encode_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 where the value is the column's mode (smallest on ties), else 0; null is 0."""
    modes = column_modes(df, columns)
    return df.withColumns({
        c: F.coalesce((quoted(c) == F.lit(modes[c])).cast("int"), F.lit(0)) for c in columns
    })


def _label(column: str) -> Column:
    return F.coalesce(quoted(column).cast("string"), F.lit("nan"))


def label_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n, code``: the place of each distinct value of each column in code point order.

    ``column`` is the place in ``columns``. One grouping and one range sort of (column, value), whatever the number of
    columns; the sorted dictionary is written, so it can be read by several look-ups.
    """
    values = F.array(*[F.struct(F.lit(i).alias("column"), _label(c).alias("value")) for i, c in enumerate(columns)])
    counts = df.select(F.inline(values)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("bigint").alias("one"))
    placed, _ = running_sums(counts, [F.col("column"), F.col("value")], ["one"], "column")
    return placed.select("column", "value", "n", F.col("_one").alias("code"))


def label_codes(df: DataFrame, column: str) -> Lookup:
    """``(value, n, code)``: the place of each distinct value in code point order."""
    codes = label_dictionary(df, [column]).drop("column")
    sizes = codes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Lookup(codes, sizes[0], sizes[1])


def encode_label(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace values by their place among the sorted distinct values; null reads as ``nan``.

    Columns whose dictionary is small enough, in bytes, get their codes from a broadcast, with no
    shuffle of the rows. All others go through one join together: their values become rows
    (row, column, value), which meet the dictionary and are grouped back by row.
    """
    if not columns:
        return df
    words = label_dictionary(df, columns)
    sizes = {r["column"]: (r["bytes"], r["words"], r["n"]) for r in words.groupBy("column").agg(
        F.sum(F.octet_length("value") + 32).alias("bytes"), F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()}
    held, room = [], BROADCAST_BYTES
    for i in sorted(sizes, key=lambda i: sizes[i][0]):
        if sizes[i][0] > room:
            break
        room -= sizes[i][0]
        held.append(i)
    spread = [i for i in range(len(columns)) if i not in held]
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("_row")
    out, codes = df.select(row, *[_label(c).alias(f"_value{i}") for i, c in enumerate(columns)]), {}
    for i in held:
        mine = words.where(F.col("column") == i).select(F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}"))
        out = out.join(F.broadcast(mine), f"_value{i}", "left")
        codes[columns[i]] = F.col(f"_code{i}")
    if spread:
        path = shared_path(df.sparkSession, "rows-to-encode")
        out.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
        out = df.sparkSession.read.parquet(path)  # written, so that a row's number is the same in both uses
        long = out.select("_id", F.inline(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"_value{i}").alias("value")) for i in spread])))
        at = words.where(F.col("column").isin(*spread)).select(F.struct("column", "value").alias("at"), "n", "code")
        coded = lookup_join(long, Lookup(at, sum(sizes[i][1] for i in spread), sum(sizes[i][2] for i in spread)),
                            F.struct("column", "value"), "at", ["code"])
        gathered = coded.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("column", "code"))).alias("_codes"))
        out = out.join(gathered, "_id")
        codes |= {columns[i]: F.element_at("_codes", F.lit(i)) for i in spread}
    return out.select(*[codes[c].alias(c) if c in codes else F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(df.columns)])


def scaling_moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a deviation of 0 becomes 1."""
    if not columns:
        return {}
    row = df.agg(*[e for c in columns for e in (F.avg(present(df, c)), F.stddev_pop(present(df, c)))]).first()
    return {c: (row[2 * i], row[2 * i + 1] or 1.0) for i, c in enumerate(columns) if row[2 * i] is not None}


def scale_standard(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    moments = scaling_moments(df, numeric_columns(df) if columns is None else columns)
    return df.withColumns({
        c: (present(df, c).cast("double") - F.lit(float(mean))) / F.lit(float(std)) for c, (mean, std) in moments.items()
    })


scale_normalize = scale_standard  # the preprocessing step "normalize_numeric" is the same scaling


def ratio_features(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """``a_div_b`` for every i < j whose divisor never comes to 0."""
    columns = numeric_columns(df) if columns is None else columns
    if len(columns) < 2:
        return df, {}
    row = df.agg(*[F.min(F.abs(present(df, c))) for c in columns]).first()
    smallest = dict(zip(columns, row))
    pairs = [(a, b) for a, b in combinations(columns, 2) if smallest[b] is not None and smallest[b] > 0]
    made = {f"{a}_div_{b}": [a, b] for a, b in pairs}
    kept = [quoted(c) for c in df.columns if c not in made]
    return df.select(*kept, *[(quoted(a) / quoted(b)).alias(n) for n, (a, b) in made.items()]), made


def square_feature(df: DataFrame, column: str | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    column = column or numeric_columns(df)[0]
    name = f"{column}_squared"
    return df.withColumn(name, quoted(column) * quoted(column)), {name: [column]}


def bin_features(df: DataFrame, column: str, bins: int = 5, equal_width: bool = True) -> DataFrame:
    """Add ``<column>_bin`` (1-based): equal-width bins, or bins at the exact quantiles."""
    value = present(df, column).cast("double")
    if equal_width:
        low, high = df.agg(F.min(value), F.max(value)).first()
        if low is None or low == high:
            return df.withColumn(f"{column}_bin", F.when(value.isNotNull(), 1))
        place = F.least(F.floor((value - low) / F.lit(float(high - low)) * bins) + 1, F.lit(bins))
        return df.withColumn(f"{column}_bin", F.when(value.isNotNull(), place.cast("int")))
    cuts = exact_quantiles(df, [column], [i / bins for i in range(1, bins)])[column]
    place = F.lit(1)
    for cut in cuts:
        place = place + F.when(value > F.lit(cut), 1).otherwise(0)
    return df.withColumn(f"{column}_bin", F.when(value.isNotNull(), place))


def transform_features(df: DataFrame) -> tuple[DataFrame, FeaturePlan]:
    """Encode, scale, then derive ratios and a square from the scaled columns."""
    texts = string_columns(df)
    two = [c for c, d in small_cardinalities(df, texts, 2).items() if d == 2]
    plan = FeaturePlan(numeric_columns(df), two, [c for c in texts if c not in two])
    out = encode_binary(df, plan.binary) if plan.binary else df
    out = encode_label(out, plan.categorical)
    out = scale_standard(out, plan.numeric) if plan.numeric else out
    if plan.numeric:
        out, ratios = ratio_features(out, plan.numeric)
        out, square = square_feature(out, plan.numeric[0])
        plan.lineage = {**ratios, **square}
    return out, plan
