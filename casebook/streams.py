"""Streaming queries over the events file, run to the end of what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sondage.session import shared_path
from sondage.streaming import bus, totals

from .aggregates import rounded
from .fixtures import sql_shape
from .registry import case


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # Written as a pattern, the path may be one file as well as a folder of files.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")


def _messages(events: DataFrame) -> DataFrame:
    """Each event as a message on the topic of its type; ids repeat when a batch is retried."""
    data = F.to_json(F.struct("event_id", "value"))
    return events.select(bus.envelope(data, F.col("event_type"), F.col("user_id"), F.concat(F.lit("m"), F.col("event_id")),
                                      F.col("ts")).alias("value"))


def _published(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark, "bus")
    bus.publish_files(_messages(_events(spark, sf_dir)), path, shared_path(spark, "bus-state")).awaitTermination()
    return path


_MESSAGE_SQL = """SELECT 'm' || event_id AS id, CAST(user_id AS VARCHAR) AS sender_id, event_type AS topic,
    CAST(event_id AS BIGINT) AS event_id, value FROM events"""


def _opened(messages: DataFrame) -> DataFrame:
    body = F.from_json("data", "event_id bigint, value double")
    return messages.select("id", "sender_id", "topic", body["event_id"].alias("event_id"), body["value"].alias("value"))


@case("stream_publish", _MESSAGE_SQL)
def stream_publish(spark, sf_dir):
    return _opened(bus.parse_messages(spark.read.text(_published(spark, sf_dir))))


@case("stream_ingest", _MESSAGE_SQL)
def stream_ingest(spark, sf_dir):
    out = shared_path(spark, "ingested")
    stream = _opened(bus.from_files(spark, _published(spark, sf_dir)))
    stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", shared_path(spark, "ingest-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@case("stream_route", """
    SELECT event_type AS topic, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1""")
def stream_route(spark, sf_dir):
    path = _published(spark, sf_dir)
    out = {topic: shared_path(spark, f"topic-{topic}") for topic in ("click", "purchase")}

    def broken(batch: DataFrame, batch_id: int) -> None:
        raise ValueError("a handler that always fails")

    queries = [bus.subscribe(bus.from_files(spark, path), "view", broken, shared_path(spark, "route-state"))]
    queries += [bus.subscribe(bus.from_files(spark, path), topic, bus.table_handler(folder), shared_path(spark, "route-state"))
                for topic, folder in out.items()]
    for query in queries:
        query.awaitTermination()
    delivered = [spark.read.parquet(folder).drop("batch") for folder in out.values()]
    opened = _opened(delivered[0].unionByName(delivered[1]))
    return rounded(opened.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", places=4)


def _metric_stream(spark, sf_dir):
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("agent_type"), F.col("event_type").alias("task_type"),
        F.col("value").alias("duration"), (F.col("event_type") != "error").alias("success"), "ts")


def _run(spark, stream, keys):
    out = shared_path(spark, "totals")
    totals.run_totals(stream, out, shared_path(spark, "totals-state"), keys, every=1).awaitTermination()
    return totals.read_totals(spark, out, keys)


@case("stream_task_totals", f"""
    SELECT agent_type, task_type, COUNT(*) AS total, COUNT(*) FILTER (success) AS success, COUNT(*) FILTER (NOT success) AS failure,
           ROUND(SUM(duration), 4) AS total_duration, ROUND(AVG(duration), 6) AS avg_duration FROM {sql_shape('metric_events')} GROUP BY 1, 2""")
def stream_task_totals(spark, sf_dir):
    found = _run(spark, totals.task_totals(_metric_stream(spark, sf_dir)), ["agent_type", "task_type"])
    return rounded(rounded(found, "total_duration", places=4), "avg_duration")


@case("stream_error_totals", f"""
    SELECT agent_type, error_type, COUNT(*) AS n_errors FROM {sql_shape('metric_events')} WHERE error_type IS NOT NULL GROUP BY 1, 2""")
def stream_error_totals(spark, sf_dir):
    errors = _metric_stream(spark, sf_dir).where("NOT success").withColumn(
        "error_type", F.concat(F.lit("type"), (F.col("id") % 3).cast("string")))
    return _run(spark, totals.error_totals(errors), ["agent_type", "error_type"])


@case("stream_latest_gauge", f"SELECT key, arg_max(value, ts) AS value FROM {sql_shape('gauges')} GROUP BY key")
def stream_latest_gauge(spark, sf_dir):
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("active_", "memory_", "cpu_", "disk_")]), (F.col("event_id") % 4 + 1).cast("int"))
    gauges = _events(spark, sf_dir).select(
        F.concat(prefix, F.col("user_id").cast("string")).alias("key"), "value", "ts", F.col("event_id").alias("id"))
    return _run(spark, totals.latest_gauge(gauges), ["key"])
