"""Session set-up and the shared folder that checkpoints and tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def build_session(app: str = "sondage", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps.

    Partition counts are left to the cluster's own settings; AQE coalesces small
    shuffles and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Checkpoints go when nothing refers to them any more, not never.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Recording the call site of every column expression makes wide plans slow to build.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: on a
    cluster such a folder would be lost with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="sondage-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a table that a job writes and reads."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: later uses read only the columns they need.

    Columns go by their places in the file, so any name will do; those of no type hold nulls and are not written.
    """
    path = shared_path(df.sparkSession, name)
    fields = df.schema.fields
    typed = [i for i, f in enumerate(fields) if not isinstance(f.dataType, T.NullType)]
    df.toDF(*[f"c{i}" for i in range(len(fields))]).select(*[f"c{i}" for i in typed], F.lit(True).alias("row")).write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.select(*[(F.col(f"c{i}") if i in typed else F.lit(None)).alias(f.name) for i, f in enumerate(fields)])
