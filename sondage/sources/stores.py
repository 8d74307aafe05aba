"""Writing tables and result records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def stem_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def write_table(df: DataFrame, folder: str, source: str, suffix: str, fmt: str = "parquet") -> str:
    """Write under ``<stem>_<suffix>.<fmt>`` and return the path; parquet keeps the types."""
    path = f"{folder.rstrip('/')}/{stem_of(source)}_{suffix}.{fmt}"
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def write_results_json(df: DataFrame, path: str) -> str:
    """One JSON object per row, nested values included."""
    df.write.mode("overwrite").json(path)
    return path


def append_rows(df: DataFrame, path: str) -> str:
    """Append to a keyed store or a log; a row is never rewritten in place."""
    df.write.mode("append").parquet(path)
    return path


def union_files(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of the same kind under one another, marked with their ``table_id``."""
    marked = [t.withColumn("table_id", F.lit(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
