"""An inverted-file index over vectors: cells around k-means centres, probed nearest first, re-ranked exactly.

Every vector goes, in whole, to the table of the cell whose centre it is nearest to by angle.
Centres are fitted on a bounded sample (``SAMPLE`` rows a cell); all rows are indexed. A
search reads the cells nearest to its questions only and ranks what is in them by the exact
similarity.

With ``exact`` it goes on until nothing can be missing: no vector of a cell is nearer to a
question than the cell's centre less the cell's radius, so the cells that could still beat
the k-th best found, and no others, are read as well. Results then equal a full scan's.

Rows without a vector are not indexed; vectors of length 0 have a cell of their own and a
similarity of 0. Vectors must all have one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.vectors import COMPARE_DECIMALS
from ..schema import quoted

SAMPLE = 64
MOST_CELLS = 4096
ZERO = -1  # the cell of vectors without a direction
SLACK = 2e-6  # similarities are compared to six places


def units(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A batch of equally long lists as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


@dataclass(frozen=True)
class VectorIndex:
    """An index at ``path``: ``rows`` by cell, and ``cells`` with centre, radius and size."""

    spark: SparkSession
    path: str
    key_type: str = "bigint"

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"key {self.key_type}, vector array<double>, cell int, angle double").parquet(f"{self.path}/rows")

    @staticmethod
    def build(candidates: DataFrame, path: str, key: str, vector: str = "embedding", cells: int | None = None,
              seed: int = 42) -> VectorIndex:
        """Index all rows; about the square root of their number of cells unless told."""
        held = candidates.select(quoted(key).alias("key"), quoted(vector).cast("array<double>").alias("vector")).where("vector is not null")
        n = held.count()
        k = min(cells or max(math.isqrt(n), 1), MOST_CELLS)
        share = min(1.0, 2.0 * k * SAMPLE / max(n, 1))
        drawn = held.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
        direct = drawn.where(F.exists("vector", lambda x: x != 0)).limit(2 * k * SAMPLE)
        centres = np.zeros((0, 0))
        if not direct.isEmpty():
            fitted = KMeans(k=k, seed=seed, maxIter=15, distanceMeasure="cosine", featuresCol="f").fit(
                direct.select(array_to_vector("vector").alias("f")))
            centres = units(np.array(fitted.clusterCenters()))
        shared = candidates.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS rows

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = units(matrix(batch.column("vector")))
                there = found.any(axis=1) if found.size else np.zeros(len(found), bool)
                cell, angle = np.full(len(found), ZERO), np.zeros(len(found))
                if there.any() and len(shared.value):
                    scores = found[there] @ shared.value.T
                    cell[there] = scores.argmax(axis=1)
                    angle[there] = np.arccos(np.clip(scores.max(axis=1), -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(angle)],
                                                 ["key", "vector", "cell", "angle"])

        kind = held.schema["key"].dataType.simpleString()
        rows = held.mapInArrow(placed, f"key {kind}, vector array<double>, cell int, angle double")
        # Sorted by cell, so that a search reads the row groups of its cells; a cell with very many rows is spread over files.
        rows.repartitionByRange("cell", "key").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/rows")
        spark = candidates.sparkSession
        made = VectorIndex(spark, path, kind)
        stats = made._rows().groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
        listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)] + [(ZERO, [])], "cell int, centre array<double>")
        listed.join(stats, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return made

    def search(self, questions: list[tuple[int, list[float]]], k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """``question_id, key, similarity, rank``: the k most similar rows of each question, smallest key first on ties."""
        cells = self.spark.read.schema("cell int, centre array<double>, radius double, n bigint").parquet(f"{self.path}/cells").orderBy("cell").collect()  # at most MOST_CELLS rows
        asked = units(np.array([v for _, v in questions], dtype=np.float64)) if questions else np.zeros((0, 0))
        # The least angle at which a cell can hold a vector, per question; a right angle for what has no direction.
        angles = np.full((len(questions), len(cells)), math.pi / 2)
        for place, cell in enumerate(cells):
            if cell["cell"] != ZERO:
                angles[:, place] = np.arccos(np.clip(asked @ np.array(cell["centre"]), -1.0, 1.0))
        nearest = np.argsort(angles, axis=1, kind="stable")
        chosen = [set(row[:probes].tolist()) for row in nearest]
        found = self._ranked(questions, asked, cells, chosen, k)
        if not exact:
            return found
        best = found.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least")).collect()
        reached = {r["question_id"]: r["least"] if r["n"] >= k else -1.0 for r in best}
        radii = np.array([c["radius"] if c["cell"] != ZERO else 0.0 for c in cells])
        ceiling = np.cos(np.clip(angles - radii, 0.0, math.pi))
        ceiling[~asked.any(axis=1)] = 0.0  # a question without a direction is as similar to anything
        more = [{p for p in range(len(cells)) if ceiling[q, p] >= reached.get(questions[q][0], -1.0) - SLACK}
                for q in range(len(questions))]
        return self._ranked(questions, asked, cells, [a | b for a, b in zip(chosen, more)], k)

    def _ranked(self, questions, asked: np.ndarray, cells: list, chosen: list[set[int]], k: int) -> DataFrame:
        """The best k of each question among the rows of its cells."""
        numbers = sorted({cells[p]["cell"] for some in chosen for p in some})
        rows = self._rows().where(F.col("cell").isin(numbers)).select("key", "vector", "cell")
        wanted: dict[int, list[int]] = {}
        for question, some in enumerate(chosen):
            for p in some:
                wanted.setdefault(cells[p]["cell"], []).append(question)
        ids = [q for q, _ in questions]

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Per batch and cell the k best of each question, with all that ties with the last of them."""
            for batch in batches:
                held, cell = units(matrix(batch.column("vector"))), batch.column("cell").to_numpy()
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for number in np.unique(cell).tolist():
                    at = np.flatnonzero(cell == number)
                    scores = held[at] @ asked[wanted[number]].T
                    for place, question in enumerate(wanted[number]):
                        mine = np.round(scores[:, place], COMPARE_DECIMALS)
                        keep = np.arange(len(at)) if len(at) <= k else np.flatnonzero(mine >= np.partition(mine, len(at) - k)[len(at) - k])
                        out.append((np.full(len(keep), ids[question]), at[keep], scores[keep, place]))
                parts = [np.concatenate(p) for p in zip(*out)] or [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts[0].astype(np.int64)), batch.column("key").take(pa.array(parts[1].astype(np.int64))), pa.array(parts[2])],
                    ["question_id", "key", "similarity"])

        schema = T.StructType([T.StructField("question_id", T.LongType()), rows.schema["key"], T.StructField("similarity", T.DoubleType())])
        order = Window.partitionBy("question_id").orderBy(F.desc(F.round("similarity", COMPARE_DECIMALS)), F.asc("key"))
        return rows.mapInArrow(scored, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
