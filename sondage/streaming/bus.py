"""The topic bus: messages in, messages out, one query per subscription."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

ENVELOPE = "id string, timestamp string, sender_id string, topic string, data string"

_log = logging.getLogger(__name__)


def from_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Messages of a Kafka topic from the latest offset on; needs the Kafka package on the class path."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "latest").load()
    )
    return parse_messages(raw.select(F.col("value").cast("string").alias("value")))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Messages from files of one JSON envelope per line."""
    return parse_messages(spark.readStream.text(path))


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """The messages of JSON lines; lines that are none are what ``malformed`` gives."""
    return raw.select(F.from_json(column, ENVELOPE).alias("m")).select("m.*").where("id is not null")


def malformed(raw: DataFrame, column: str = "value") -> DataFrame:
    """The lines without a readable envelope and id, as they came: to be counted or kept by a query of their own."""
    return raw.where(F.from_json(column, ENVELOPE)["id"].isNull()).select(F.col(column).alias("value"))


def envelope(data: Column, topic: Column, sender: Column, message_id: Column | None = None,
             timestamp: Column | None = None) -> Column:
    """A message as JSON text. Give ``message_id`` where a retried batch must repeat its ids."""
    return F.to_json(F.struct(
        (message_id if message_id is not None else F.uuid()).alias("id"),
        F.date_format(timestamp if timestamp is not None else F.current_timestamp(),
                      "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        sender.cast("string").alias("sender_id"), topic.cast("string").alias("topic"), data.alias("data")))


def publish_files(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the ``value`` lines of a stream to files, all that is available now."""
    return (messages.select("value").writeStream.format("text").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def publish_topic(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    return (messages.select("value").writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).option("checkpointLocation", checkpoint).start())


def subscribe(messages: DataFrame, topic: str, handler: Callable[[DataFrame, int], None], checkpoint: str,
              available_now: bool = True, failed: str | None = None) -> StreamingQuery:
    """Deliver the messages of one topic to one handler; stop the query to unsubscribe.

    Each subscription is its own query, so handlers do not hold one another up.
    A batch whose handler fails is logged and passed over; with ``failed`` its messages are
    kept below that folder, from where they can be delivered again.
    """
    keep = table_handler(failed) if failed else None

    def deliver(batch: DataFrame, batch_id: int) -> None:
        try:
            handler(batch, batch_id)
        except Exception:
            _log.exception("handler of topic %s failed on batch %s", topic, batch_id)
            if keep:
                keep(batch, batch_id)

    writer = messages.where(F.col("topic") == topic).writeStream.foreachBatch(deliver).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def table_handler(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to its own folder: a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
