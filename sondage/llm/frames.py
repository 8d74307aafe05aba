"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import shared_path

SLICE_BYTES = 2 << 20  # text handled at a time inside a task, so that temporaries stay small


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns under fixed names: what else a table holds, under whatever name, cannot clash."""
    return df.select(*[column(old).alias(new) for new, old in names.items()])


_held: list[list[str]] = []  # the tables saved in each open ``cleared``


def saved(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor repeats a read, not the work, and
    Python output that is read twice is the same both times.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    for scope in _held:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were saved inside when it ends: what is made of them must be written by then."""
    scope: list[str] = []
    _held.append(scope)
    try:
        yield
    finally:
        _held.pop()
        for path in scope:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder, whatever file system that is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_hash(seed: int) -> Column:
    return F.xxhash64("text", F.lit(seed)).alias("_hash")


def drawn_hashes(hashes: DataFrame, label: str, per_label: int) -> DataFrame:
    """Of rows (label, _hash) about ``per_label`` distinct hashes of each label, never more than twice that: the smallest."""
    size = 1 << 20
    distinct = hashes.select(label, "_hash").distinct()
    totals = {r[label]: r["count"] for r in distinct.groupBy(label).count().collect()}
    if not totals:
        return hashes.select(label, "_hash").limit(0)
    draw = F.pmod("_hash", F.lit(size))
    wanted = F.create_map(*[F.lit(x) for name in sorted(totals) for x in (name, size * per_label / totals[name])])
    place = F.row_number().over(Window.partitionBy(label).orderBy(draw, "_hash"))
    picked = distinct.where(draw < wanted[F.col(label)]).withColumn("_place", place)
    return saved(picked.where(F.col("_place") <= 2 * per_label).select(label, "_hash"), "sample-hashes")


def drawn_texts(texts: DataFrame, chosen: DataFrame, label: str, seed: int) -> DataFrame:
    """``label, text``: the texts of the drawn hashes, which are few and broadcast; each once."""
    return texts.select("text", text_hash(seed)).join(F.broadcast(chosen), "_hash").select(label, "text").distinct()


def distinct_sample(rows: DataFrame, label: str, per_label: int, seed: int) -> DataFrame:
    """``label, text``: a bounded sample by text hash. Copies count once, so they cannot leave a sample of one text."""
    chosen = drawn_hashes(rows.select(label, text_hash(seed)), label, per_label)
    return drawn_texts(rows, chosen, label, seed)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets between them; a null text has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text; a longer text is a piece of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths + 64, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_slices(df: DataFrame, text: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | object,
               limit: int = SLICE_BYTES) -> DataFrame:
    """Arrow batches through ``work``, some megabytes of text at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, text, limit):
                yield work(piece)

    return df.mapInArrow(task, schema)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """The frame with each row's ``position`` in the order and, by name, the sums of what stands before it.

    Spark range-sorts; one row of totals per partition reaches the driver.
    """
    sums = {"position": F.lit(1).cast("long"), **(sums or {})}
    valued = df.select("*", *[value.alias(f"_v_{name}") for name, value in sums.items()])
    stamped = saved(valued.orderBy(*order).withColumn("_stamp", F.monotonically_increasing_id()), "ordered").withColumn(
        "_part", F.shiftright("_stamp", 33).cast("int"))
    totals = stamped.groupBy("_part").agg(*[F.sum(f"_v_{name}").alias(name) for name in sums]).orderBy("_part").collect()
    offsets, before = [], {name: 0 for name in sums}
    for row in totals:
        offsets.append((row["_part"], *before.values()))
        before = {name: total + row[name] for name, total in before.items()}
    schema = "_part int, " + ", ".join(f"_b_{name} bigint" for name in sums)
    start = df.sparkSession.createDataFrame(offsets, schema)  # one row per partition, whatever the table holds
    within = Window.partitionBy("_part").orderBy("_stamp").rowsBetween(Window.unboundedPreceding, -1)
    placed = {name: F.col(f"_b_{name}") + F.coalesce(F.sum(f"_v_{name}").over(within), F.lit(0)) for name in sums}
    return stamped.join(F.broadcast(start), "_part").withColumns(placed).drop(
        "_part", "_stamp", *[f"_{kind}_{name}" for kind in "vb" for name in sums])
