"""Global order without a one-partition window.

Ranks, label codes and contiguous folds need every row's place in a total
order. The table is range-sorted by Spark, each row is stamped with its
partition and place in it, and only one count per partition reaches the driver
to turn the stamps into global positions. The stamped table is checkpointed
first: the sampled range boundaries may differ between two evaluations, so both
uses must read the same written rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .schema import quoted
from .session import checkpoint_dir

_PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the partition above bit 33
_BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
_HOT_SHARE = 1_000
_SALTS = 1_024


def _stamped(df: DataFrame, order: list[Column]) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    stamped = df.orderBy(*order).withColumn("_stamp", F.monotonically_increasing_id())
    stamped = stamped.checkpoint(eager=True)
    return (
        stamped.withColumn("_part", F.shiftright("_stamp", _PARTITION_SHIFT).cast("int"))
        .withColumn("_place", F.col("_stamp").bitwiseAND((1 << _PARTITION_SHIFT) - 1))
    )


def dense_index(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in the given total order."""
    stamped = _stamped(df, order)
    counts = stamped.groupBy("_part").count().orderBy("_part").collect()
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["_part"], total))
        total += row["count"]
    # One row per partition, so it is small whatever the table holds.
    start = df.sparkSession.createDataFrame(offsets, "_part int, _before bigint")
    placed = stamped.join(F.broadcast(start), "_part").withColumn(name, F.col("_before") + F.col("_place"))
    return placed.drop("_stamp", "_part", "_place", "_before")


def cut_keys(df: DataFrame, group: Column, key: Column, wanted: DataFrame) -> DataFrame:
    """``group, cuts``: per group the keys that stand at given places of its order, as a map from a number to the key.

    ``wanted`` has ``group``, ``start`` (rows in groups that sort before), ``number`` and ``place`` (from 0 in the
    group). Only groups and keys are sorted, not the rows they come from.
    """
    placed = dense_index(df.select(group.alias("group"), key.alias("key")), [F.col("group"), F.col("key")], "_position")
    at = wanted.select(F.col("group").alias("_group"), "number", (F.col("start") + F.col("place")).alias("_position"))
    found = at.join(placed, "_position").select("_group", "number", "key")
    return found.groupBy(F.col("_group").alias("group")).agg(
        F.map_from_entries(F.collect_list(F.struct("number", "key"))).alias("cuts"))


@dataclass(frozen=True)
class Lookup:
    """A table of unique keys with the number of rows behind each, its own row count and their total."""

    table: DataFrame
    rows: int
    total: int


def running_sums(df: DataFrame, order: list[Column], sums: list[str], group: str) -> tuple[DataFrame, list]:
    """Add, as ``_<name>``, what each of the sums comes to in the rows of the same group that stand before.

    ``group`` is the first column of the order and has few values (they are column names or
    places); its totals, ``group, rows`` and the sums, are given beside the table.
    """
    stamped = _stamped(df, order)
    totals = (stamped.groupBy("_part", group).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(s).alias(s) for s in sums])
              .orderBy("_part").collect())
    whole: dict[object, dict[str, int]] = {}
    offsets = []
    for row in totals:
        done = whole.setdefault(row[group], {"rows": 0, **dict.fromkeys(sums, 0)})
        offsets.append((row["_part"], row[group], *[done[s] for s in sums]))
        for name in done:
            done[name] += row[name]
    kind = df.schema[group].dataType.simpleString()
    start = df.sparkSession.createDataFrame(offsets, f"_part int, {group} {kind}, " + ", ".join(f"_b_{s} bigint" for s in sums))
    within = Window.partitionBy("_part", group).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    placed = stamped.join(F.broadcast(start), ["_part", group]).withColumns(
        {f"_{s}": F.col(f"_b_{s}") + F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums})
    return placed.drop("_stamp", "_part", "_place", *[f"_b_{s}" for s in sums]), [{group: k, **v} for k, v in whole.items()]


def lookup_join(df: DataFrame, lookup: Lookup, key: Column, table_key: str, values: list[str], n: str = "n") -> DataFrame:
    """Add the ``values`` of a lookup table to rows whose keys may be very uneven (left join).

    A small table, in rows and in the bytes of its keys and values, is broadcast. Of a
    larger one only the hot keys are, those that hold more than a thousandth of the rows, so
    fewer than a thousand. Rows they serve, and rows without a key, take no part in the
    shuffled join that serves the others: they are spread over its tasks by a hash of the
    row. The rows travel as one value, so no column name of theirs can clash.
    """
    held = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("_held")
    back = [F.col(f"_held.c{i}").alias(c) for i, c in enumerate(df.columns)]
    table = lookup.table.select(F.col(table_key).alias("_key"), F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
                                .alias("_found"), F.col(n).alias("_rows"))
    keyed = df.select(held, key.alias("_key"))

    def given(found: Column) -> list[Column]:
        return [found[f"v{i}"].alias(v) for i, v in enumerate(values)]

    if lookup.rows <= _BROADCAST_ROWS and _bytes(table) <= BROADCAST_BYTES:
        return keyed.join(F.broadcast(table.drop("_rows")), "_key", "left").select(*back, *given(F.col("_found")))
    hot = table.where(F.col("_rows") * _HOT_SHARE > lookup.total)
    cold = table.where(F.col("_rows") * _HOT_SHARE <= lookup.total)
    served = keyed.join(F.broadcast(hot.select("_key", F.col("_found").alias("_hot"))), "_key", "left")
    done = F.col("_hot").isNotNull() | F.col("_key").isNull()
    spread = F.pmod(F.xxhash64("_held"), F.lit(_SALTS)).cast("int")
    rest = served.withColumns({"_salt": F.when(done, spread).otherwise(-1), "_key": F.when(~done, F.col("_key"))})
    sparse = cold.select("_key", F.lit(-1).alias("_salt"), F.col("_found").alias("_cold"))
    joined = rest.join(sparse, ["_key", "_salt"], "left")
    return joined.select(*back, *given(F.coalesce("_hot", "_cold")))


def _bytes(table: DataFrame) -> int:
    """Bytes of a look-up table; only texts, arrays and the like are measured, numbers have a known size."""
    kinds = [table.schema[c].dataType.simpleString() for c in ("_key", "_found")]
    if not any(word in kind for kind in kinds for word in ("string", "binary", "array", "map")):
        return 0
    return table.agg(F.sum(F.octet_length(F.to_json(F.struct("_key", "_found"))))).first()[0] or 0
