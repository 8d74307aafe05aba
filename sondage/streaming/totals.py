"""Running totals: streaming aggregates kept in checkpointed state, and the table they are read from.

Totals never expire, as in a counter, and are plain streaming aggregates. Where keys should
go again, ``expiring_totals`` keeps them in value state with a timer: a key not seen for
``ttl`` of event time is given out once more, marked ``expired``, and leaves the state.

The table is a base and the changes since. Each batch writes its changed keys to a folder of
its own, so a repeated batch replaces itself; every ``COMPACT`` batches base and changes
become the next base and the old folders go. A reader opens one base and fewer than
``COMPACT`` folders, however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.catalog import latest_per_key

COMPACT = 10
#: Spark keeps such state in this store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def task_totals(events: DataFrame) -> DataFrame:
    """Runs, successes, failures, total and mean seconds per (agent, task type)."""
    return events.groupBy("agent_type", "task_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("success"),
        F.count_if(~F.col("success")).alias("failure"), F.sum("duration").alias("total_duration"),
        F.avg("duration").alias("avg_duration"))


def error_totals(errors: DataFrame) -> DataFrame:
    return errors.groupBy("agent_type", "error_type").agg(F.count(F.lit(1)).alias("n_errors"))


def latest_gauge(gauges: DataFrame) -> DataFrame:
    """Last value per gauge key."""
    return gauges.groupBy("key").agg(F.max_by("value", F.struct("ts", "id")).alias("value"))


class _Sums(StatefulProcessor):
    """Count and sums of a key's rows, until it has not been seen for a while."""

    def __init__(self, keys: list[str], sums: list[str], ttl_ms: int):
        self.keys, self.sums, self.ttl_ms = keys, sums, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(["n bigint", *[f"{s} double" for s in self.sums], "seen bigint"])
        self.state = handle.getValueState("sums", fields)

    def _row(self, key: tuple, values: list, expired: bool) -> pd.DataFrame:
        row = {**dict(zip(self.keys, key)), "n": values[0], **dict(zip(self.sums, values[1:])), "expired": expired}
        return pd.DataFrame([row])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.state.get()) if self.state.exists() else [0, *[0.0] * len(self.sums), 0]
        for batch in rows:
            held[0] += len(batch)
            for place, name in enumerate(self.sums, start=1):
                held[place] += float(batch[name].sum())
            held[-1] = max(held[-1], int(batch["seen_at"].max()))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(held[-1] + self.ttl_ms)
        self.state.update(tuple(held))
        yield self._row(key, held[:-1], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.state.get()) if self.state.exists() else [0, *[0.0] * len(self.sums), 0]
        self.state.clear()
        yield self._row(key, held[:-1], True)

    def close(self) -> None:
        pass


def expiring_totals(events: DataFrame, keys: list[str], sums: list[str], event_time: str, ttl: str, late: str = "0 seconds") -> DataFrame:
    """``keys, n, sums, expired`` of the keys that changed: rows and sums per key of a stream.

    ``ttl`` is an interval such as ``2 hours``. A key without rows for that long, by the watermark (``late`` behind the
    newest row), is given out as expired with its last sums; rows that come after that start anew.
    """
    marked = events.withColumn("seen_at", F.unix_millis(F.col(event_time).cast("timestamp"))).withColumn(
        event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late)
    rows = marked.select(*keys, *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in sums], "seen_at", event_time)
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000)
    out = T.StructType([*[events.schema[k] for k in keys], T.StructField("n", T.LongType()),
                        *[T.StructField(s, T.DoubleType()) for s in sums], T.StructField("expired", T.BooleanType())])
    return rows.groupBy(*keys).transformWithStateInPandas(
        _Sums(keys, sums, millis), outputStructType=out, outputMode="Update", timeMode="EventTime")


def run_totals(totals: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, every: int = COMPACT) -> StreamingQuery:
    """Write the changed totals of all that is available now; restarting goes on from the checkpoint.

    With ``keys`` the table is compacted every so many batches.
    """
    return (totals.writeStream.outputMode("update").foreachBatch(compacting_handler(path, keys, every))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def compacting_handler(path: str, keys: list[str] | None, every: int = COMPACT) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch's changes, and a new base every so many batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/changes-{batch_id}")
        if keys is None or (batch_id + 1) % every:
            return
        _newest(spark, path, keys, up_to=batch_id).write.mode("overwrite").parquet(f"{path}/base-{batch_id}")
        # Only now that the base is whole do its parts go; a crash before leaves them to the next base.
        for name, number in _folders(spark, path):
            if number < batch_id or name == f"changes-{batch_id}":
                _delete(spark, f"{path}/{name}")

    return write


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Bases and changes that are written to the end, with their batch numbers."""
    files, place = _file_system(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    split = [(n, n.rpartition("-")) for n in names]
    known = [(n, int(number)) for n, (kind, _, number) in split if kind in ("base", "changes") and number.isdigit()]
    return [(n, number) for n, number in known if files.exists(_file_system(spark, f"{path}/{n}/_SUCCESS")[1])]


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


def _newest(spark: SparkSession, path: str, keys: list[str], up_to: int | None = None) -> DataFrame:
    """The newest row of each key, from the last base and the changes since; expired keys are gone."""
    folders = [(n, b) for n, b in _folders(spark, path) if up_to is None or b <= up_to]
    base = max((b for n, b in folders if n.startswith("base-")), default=-1)
    parts = [n for n, b in folders if n == f"base-{base}" or n.startswith("changes-") and b > base]
    newest = latest_per_key(spark.read.parquet(*[f"{path}/{n}" for n in parts]), keys, F.col("batch"))
    return newest.where("not expired") if "expired" in newest.columns else newest


def read_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest total per key."""
    return _newest(spark, path, keys).drop("batch", "expired")
