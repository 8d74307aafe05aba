"""Totals equal the batch; a restart goes on from its checkpoint."""

import os

import pytest
from pyspark.sql import functions as F

from sondage.streaming import bus, totals


def _batch(spark, start, end):
    return spark.range(start, end).select(
        (F.col("id") % 3).alias("agent_type"), F.lit("t").alias("task_type"), F.col("id").cast("double").alias("duration"),
        (F.col("id") % 2 == 0).alias("success"))


def test_restart_does_not_count_twice(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = _batch(spark, 0, 1).schema
    keys = ["agent_type", "task_type"]
    for start, end in ((0, 30), (30, 100), (100, 100)):
        if start < end:
            _batch(spark, start, end).write.mode("append").parquet(source)
        stream = totals.task_totals(spark.readStream.schema(schema).parquet(source))
        totals.run_totals(stream, out, state).awaitTermination()
    streamed = sorted(map(tuple, totals.read_totals(spark, out, keys).collect()))
    batch = sorted(map(tuple, totals.task_totals(_batch(spark, 0, 100)).collect()))
    assert streamed == batch


def test_a_reader_opens_a_base_and_few_changes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = _batch(spark, 0, 1).schema
    keys = ["agent_type", "task_type"]
    for step in range(7):
        _batch(spark, step * 10, step * 10 + 10).write.mode("append").parquet(source)
        stream = totals.task_totals(spark.readStream.schema(schema).parquet(source))
        totals.run_totals(stream, out, state, keys, every=3).awaitTermination()
        assert len([n for n in os.listdir(out) if not n.startswith(".")]) <= 3
    assert sorted(n for n in os.listdir(out) if not n.startswith(".")) == ["base-5", "changes-6"]
    streamed = sorted(map(tuple, totals.read_totals(spark, out, keys).collect()))
    assert streamed == sorted(map(tuple, totals.task_totals(_batch(spark, 0, 70)).collect()))
    # A base that was not written to the end is not read.
    os.makedirs(f"{out}/base-6")
    assert sorted(map(tuple, totals.read_totals(spark, out, keys).collect())) == streamed


@pytest.fixture
def state_store(spark):
    for name, value in totals.STATE_STORE.items():
        spark.conf.set(name, value)
    yield
    for name in totals.STATE_STORE:
        spark.conf.unset(name)


def test_keys_expire_and_start_anew_after_a_restart(spark, tmp_path, state_store):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(*rows):
        frame = spark.createDataFrame([(k, float(v), f"2024-01-01 00:{m:02d}:00") for k, v, m in rows], "key string, v double, at string")
        frame.withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, v double, at timestamp").parquet(source)
        totals.run_totals(totals.expiring_totals(stream, ["key"], ["v"], "at", "10 minutes"), out, state, ["key"], every=2).awaitTermination()
        return {r["key"]: (r["n"], r["v"]) for r in totals.read_totals(spark, out, ["key"]).collect()}

    assert run(("a", 1, 0), ("a", 2, 1), ("b", 5, 2)) == {"a": (2, 3.0), "b": (1, 5.0)}
    assert run(("a", 4, 5)) == {"a": (3, 7.0), "b": (1, 5.0)}
    assert run(("a", 1, 14)) == {"a": (4, 8.0)}  # b was last seen at minute 2
    assert run(("b", 3, 15), ("c", 1, 40)) == {"c": (1, 1.0)}  # all but c are behind by more than ten minutes
    assert run(("a", 9, 41)) == {"a": (1, 9.0), "c": (1, 1.0)}


def test_what_cannot_be_read_or_handled_is_kept(spark, tmp_path):
    source, state, failed, bad = (str(tmp_path / n) for n in ("in", "state", "failed", "bad"))
    lines = ['{"id": "1", "topic": "t", "data": "x"}', "not json", '{"topic": "t"}', '{"id": "2", "topic": "u"}', ""]
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(source)

    def broken(batch, batch_id):
        raise ValueError("a handler that fails")

    bus.subscribe(bus.from_files(spark, source), "t", broken, state, failed=failed).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(failed).collect()] == ["1"]
    stray = bus.malformed(spark.readStream.text(source))
    bus.publish_files(stray, bad, state + "2").awaitTermination()
    assert sorted(r["value"] for r in spark.read.text(bad).collect()) == ["", "not json", '{"topic": "t"}']
