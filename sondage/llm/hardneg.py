"""Hard negatives for anchors, scored exactly by Kronecker-packed products.

Vectors are quantised to whole numbers. In a block of candidates each component makes one
wide integer: the candidates' values, biased to be non-negative, lie in separated fields
of it. An anchor multiplies each of these integers once by its own component and adds
them up; the fields of the sum, less the bias, are the anchor's inner products with all
candidates of the block. A field is as wide as the largest sum needs, so nothing
overflows into its neighbour and every score is exact.

Anchors are dealt in groups and rows in blocks; each task handles one group against one
block, so what a task holds is bounded by the two sizes. The best of every cell are merged
by a ranked window, which Spark limits before the shuffle. Positives come first; the
second round scores the same cells again and keeps what lies in each positive's band.

Defined results: rows with a null label, a null vector or a component that is null or not
finite take no part. Rows of equal id are rows of their own; a null id is no anchor, and
comes last among ties. Vectors of different lengths are not compared; two empty vectors
score 0. A quantised component, and a score in the result, that exceeds 64 bits is held
at the end of their range; sums are formed without bound. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import pick, saved

BLOCK = 4096  # candidates packed side by side
GROUP = 16384  # anchors that meet a block in one task
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Packed:
    """Candidates of one length, packed for anchors whose components are within ``reach``."""

    def __init__(self, vectors: np.ndarray, reach: int):
        self.count, self.length = vectors.shape
        self.bias = int(max((abs(int(x)) for x in (vectors.min(initial=0), vectors.max(initial=0))), default=0))
        # |sum of a * (c + bias)| is at most this; shifted by it, a field is in [0, 2 * most].
        self.most = self.length * reach * 2 * self.bias
        bits = (2 * self.most + 1).bit_length()
        self.bytes = 4 if bits <= 32 else 8 if bits <= 64 else -(-bits // 8)
        self.planes = [self.pack([int(x) + self.bias for x in column]) if self.bytes > 8 else
                       int.from_bytes((column + self.bias).astype(f"<u{self.bytes}").tobytes(), "little")
                       for column in vectors.T]
        self.shift = self.pack([self.most] * self.count)

    def pack(self, values: list[int]) -> int:
        return int.from_bytes(b"".join(v.to_bytes(self.bytes, "little") for v in values), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products of one anchor with every candidate."""
        total = sum(map(int.__mul__, anchor, self.planes), self.shift)
        raw = total.to_bytes(self.count * self.bytes, "little")
        less = self.most + self.bias * sum(anchor)
        if self.bytes <= 8:
            fields = np.frombuffer(raw, f"<u{self.bytes}")
            if self.bytes == 4 or self.most + abs(less) < MOST:
                return fields.astype(np.int64) - less
            return np.array([int(f) - less for f in fields], object)
        return np.array([int.from_bytes(raw[i:i + self.bytes], "little") - less for i in range(0, len(raw), self.bytes)], object)


def best(scores: np.ndarray, order: np.ndarray, wanted: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores among the wanted; ties by ``order``."""
    found = np.flatnonzero(wanted)
    if len(found) > 4 * most and scores.dtype != object:  # what is below the last of them cannot be among them
        held = scores[found]
        found = found[held >= np.partition(held, len(held) - most)[len(held) - most]]
    return np.array(sorted(found.tolist(), key=lambda i: (-scores[i], order[i]))[:most], np.int64)


def scored(cells: DataFrame, keep: int, bands: tuple[int, int, int] | None) -> DataFrame:
    """``anchor, place, row, id, score``: per cell the best rows of each anchor.

    Without bands, other rows of the anchor's label (place 0); with bands (low, high, whole),
    per positive score p in the anchor's list rows of another label with
    low * p <= whole * score <= high * p.
    """

    def work(table: pa.Table) -> pa.Table:
        is_anchor = table.column("anchor").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("id").to_pylist()
        rows = table.column("row").to_numpy()
        labels = table.column("label").to_numpy()
        vectors = table.column("vec").to_pylist()
        positives = table.column("positives").to_pylist()
        by_length: dict[int, list[int]] = {}
        for place in np.flatnonzero(~is_anchor).tolist():
            by_length.setdefault(len(vectors[place]), []).append(place)
        anchors = np.flatnonzero(is_anchor).tolist()
        out: list[list] = [[], [], [], [], []]
        for length, places in by_length.items():
            mine = [a for a in anchors if len(vectors[a]) == length]
            if not mine:
                continue
            reach = max((abs(x) for a in mine for x in vectors[a]), default=0)
            block = Packed(np.array([vectors[p] for p in places], np.int64).reshape(len(places), length)
                           if all(-MOST // 4 < x < MOST // 4 for p in places for x in vectors[p])
                           else np.array([vectors[p] for p in places], object).reshape(len(places), length), reach)
            names = [(ids[p] is None, ids[p] if ids[p] is not None else 0, int(rows[p])) for p in places]
            rank = np.empty(len(places), np.int64)
            rank[sorted(range(len(places)), key=names.__getitem__)] = np.arange(len(places))
            at = np.array(places)
            held_labels, held_rows = labels[at], rows[at]
            for a in mine:
                scores = block.scores(vectors[a])
                if bands is None:
                    chosen = [(0, best(scores, rank, (held_labels == labels[a]) & (held_rows != rows[a]), keep))]
                else:
                    low, high, whole = bands
                    other = held_labels != labels[a]
                    if scores.dtype != object and np.abs(scores).max(initial=0) > MOST // whole:
                        scores = scores.astype(object)
                    chosen = [(k, best(scores, rank, other & (scores * whole >= low * p) & (scores * whole <= high * p), keep))
                              for k, p in enumerate(positives[a] or [])]
                for k, found in chosen:
                    out[0] += [int(rows[a])] * len(found)
                    out[1] += [k] * len(found)
                    out[2] += held_rows[found].tolist()
                    out[3] += [ids[places[i]] for i in found.tolist()]
                    out[4] += [min(max(int(s), LEAST), MOST) for s in scores[found]]
        types = [pa.int64(), pa.int32(), pa.int64(), table.schema.field("id").type, pa.int64()]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["anchor", "place", "row", "id", "score"])

    kind = cells.schema["id"].dataType.simpleString()
    return cells.groupBy("group", "block").applyInArrow(
        work, f"anchor bigint, place int, row bigint, id {kind}, score bigint")


def top(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each (anchor, place) over all cells, with their ``rank``."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, anchors: Callable[[Column], Column], *, vec_id: str = "vec_id", embedding: str = "embedding",
         label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3,
         band: tuple[int, int, int] = (50, 95, 100), block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` says of an id whether its row is an anchor. Components become floor(scale * x).
    A negative for a positive of score p has low * p <= whole * score <= high * p, where
    ``band`` is (low, high, whole).
    """
    source = pick(rows, id=vec_id, vec=embedding, label=label)
    real = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform("vec", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    points = saved(source.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(real, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), "id", F.col("label").cast("bigint").alias("label"), whole.alias("vec"),
        F.coalesce(anchors(F.col("id")), F.lit(False)).alias("is_anchor")), "vectors")
    counted = points.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("a")).first()
    blocks, groups = -(-counted["n"] // block) or 1, -(-counted["a"] // group) or 1
    spread = lambda name, n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    held = ["id", "row", "label", "vec"]
    candidates = points.select(spread("block", blocks), every("group", groups), F.lit(False).alias("anchor"), *held,
                               F.lit(None).cast("array<bigint>").alias("positives"))

    def cells(chosen: DataFrame) -> DataFrame:
        return candidates.unionByName(chosen.select(
            spread("group", groups), every("block", blocks), F.lit(True).alias("anchor"), *held, "positives"))

    asked = points.where("is_anchor").withColumn("positives", F.lit(None).cast("array<bigint>"))
    near = top(scored(cells(asked), positives, None), positives)
    near = saved(near.select("anchor", (F.col("rank") - 1).cast("int").alias("place"), F.col("id").alias("positive_id"),
                             F.col("score").alias("positive_score")), "positives")
    lists = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("list"))
    banded = points.where("is_anchor").join(
        lists.select(F.col("anchor").alias("row"), F.col("list.positive_score").alias("positives")), "row")
    hard = top(scored(cells(banded), negatives, band), negatives)
    names = points.where("is_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return hard.join(near, ["anchor", "place"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
