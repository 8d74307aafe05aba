"""A trigram index for substring search: posting lists give candidates, the text itself decides.

Every distinct run of three characters of a text, in lower case, is a posting (gram, key). A
text that holds a query holds all the query's grams, so the keys that stand under its rarest
grams are candidates, and only their texts are read and tested. A query of fewer than three
characters has no gram and is answered by a scan.

Postings are range-sorted by gram and key, so a search reads the row groups of its own grams
only, and a gram with very many postings is spread over files. Keys must be unique and not
null; a null text holds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import quoted

GRAM = 3
RAREST = 4  # grams of a query that are looked up
SENT = 1 << 18  # postings a task gathers before it sends them on


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, gram`` from ``key, text`` in UTF-8: three characters are one number, so a text's grams are one sort of its length."""
    for batch in batches:
        keys = batch.column("key")
        places, found, waiting = [], [], 0
        for i, text in enumerate(batch.column("text")):
            letters = np.frombuffer((text.as_py() or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
            if len(letters) < GRAM:
                continue
            runs = np.unique(letters[:-2] << np.uint64(42) | letters[1:-1] << np.uint64(21) | letters[2:])
            places.append(np.full(len(runs), i))
            found.append(runs)
            waiting += len(runs)
            if waiting > SENT:
                yield _rows(keys, places, found)
                places, found, waiting = [], [], 0
        if found:
            yield _rows(keys, places, found)


def _rows(keys: pa.Array, places: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
    runs, which = np.unique(np.concatenate(found), return_inverse=True)
    letters = np.column_stack([runs >> np.uint64(42), runs >> np.uint64(21), runs]) & np.uint64((1 << 21) - 1)
    joined = letters.astype("<u4").tobytes().decode("utf-32-le")
    names = pa.array([joined[i:i + GRAM] for i in range(0, len(joined), GRAM)], pa.string())
    return pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(places))), names.take(pa.array(which))], ["key", "gram"])


@dataclass(frozen=True)
class TextIndex:
    """An index at ``path``: ``texts`` by key, ``postings`` by gram, and how often each ``grams`` occurs."""

    spark: SparkSession
    path: str

    def _postings(self) -> DataFrame:
        key = self.spark.read.parquet(f"{self.path}/texts").schema["key"].dataType.simpleString()
        return self.spark.read.schema(f"key {key}, gram string").parquet(f"{self.path}/postings")

    @staticmethod
    def build(df: DataFrame, path: str, key: str, text: Column) -> TextIndex:
        """Index the whole text of every row."""
        spark = df.sparkSession
        df.select(quoted(key).alias("key"), F.lower(text.cast("string")).alias("text")).write.mode("overwrite").parquet(f"{path}/texts")
        texts = spark.read.parquet(f"{path}/texts")
        kind = texts.schema["key"].dataType.simpleString()
        held = texts.select("key", F.col("text").cast("binary").alias("text"))
        postings = held.mapInArrow(_postings, f"key {kind}, gram string")
        postings.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(f"{path}/postings")
        index = TextIndex(spark, path)
        index._postings().groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/grams")
        return index

    def holding(self, query: str) -> DataFrame:
        """``key`` of every text that holds the query, ignoring case."""
        texts = self.spark.read.parquet(f"{self.path}/texts")
        low = self.spark.range(1).select(F.lower(F.lit(query)).alias("q")).first()["q"]  # the engine's own lower case
        holds = F.contains(F.col("text"), F.lit(low))
        parts = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not parts:
            return texts.where(holds).select("key")
        known = self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(parts)).collect()  # a row per gram of the query
        if len(known) < len(parts):
            return texts.limit(0).select("key")  # some gram stands nowhere
        rare = sorted(known, key=lambda r: (r["n"], r["gram"]))[:RAREST]
        postings = self._postings().where(F.col("gram").isin([r["gram"] for r in rare]))
        candidates = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).select("key")
        return texts.join(candidates, "key", "left_semi").where(holds).select("key")
