"""Best-fit packing of token sequences, hierarchically.

Documents are encoded once; each gets the end id and is cut only if it is longer
than a sequence. Every partition packs its pieces by best fit decreasing. Bins
that no remaining piece could still enter are final; the underfull ones become
items of the next round, in which a few partitions' leftovers meet and are packed
again, until one group is left or a round no longer joins anything. A group holds
at most about ``GROUP_ITEMS`` items, so no task grows with the table.

Defined results: a null text is an empty one (its sequence is the end id alone);
rows with the same or no id are packed each on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .frames import pick, saved, sliced
from .tokens import crc32, encoder, with_end

CAPACITY = 4096
END_ID = 1
LOCAL_ITEMS = 65_536  # pieces a task packs at a time
GROUP_ITEMS = 20_000  # underfull bins a task of a later round packs at a time


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit decreasing: bin and offset of each item, fill of each bin.

    Open bins are kept by room left; the bits of one integer say for which room
    there are any, so the tightest fit is the lowest bit at or above the size.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms, fills = 0, []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            place = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, place = capacity, len(fills)
            fills.append(0)
        bins[item], offsets[item] = place, capacity - room
        fills[place] = capacity - room + size
        left = room - size
        if left:
            by_room.setdefault(left, []).append(place)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def encoded_and_packed(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    """First round, with the encoding: one row per piece with its bin, its place there and the bin's fill."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        ids, bounds = with_end(*encoder(tokenizer)(batch.column("text")), end)
        lengths = np.diff(bounds)
        pieces = -(-lengths // capacity)
        row = np.repeat(np.arange(len(lengths)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(capacity, lengths[row] - start)
        at = bounds[row] + start
        crcs = [crc32(ids[a:a + n]) for a, n in zip(at.tolist(), length.tolist())]
        return {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": piece, "start": start, "length": length,
                "ids_crc32": np.array(crcs, np.int64)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = TaskContext.get().partitionId() << 33
        held: list[dict] = []
        count = 0

        def packed() -> pa.RecordBatch:
            nonlocal used
            whole = {k: np.concatenate([h[k] for h in held]) for k in ("piece", "start", "length", "ids_crc32")}
            bins, offsets, fills = best_fit(whole["length"], capacity)
            out = pa.RecordBatch.from_arrays(
                [pa.concat_arrays([h["doc_id"] for h in held]), pa.array(whole["piece"], pa.int32()),
                 *[pa.array(whole[k]) for k in ("start", "length", "ids_crc32")],
                 pa.array(bins + used), pa.array(offsets), pa.array(fills[bins])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])
            used += len(fills)
            return out

        for batch in batches:
            for part in sliced(batch, "text"):
                held.append(cut(part))
                count += len(held[-1]["piece"])
                if count >= LOCAL_ITEMS:
                    yield packed()
                    held, count = [], 0
        if held:
            yield packed()

    return docs.mapInArrow(task, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                 "bin bigint, offset bigint, fill bigint")


def merge_round(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """Pack underfull bins (bin, fill) as items, group by group: (bin, parent, offset, fill of the parent)."""
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        bins, offsets, fills = best_fit(frame["fill"].to_numpy(), capacity)
        order = np.lexsort((offsets, bins))
        first = order[np.searchsorted(bins[order], np.arange(len(fills)))]
        names = frame["bin"].to_numpy()[first]  # a merged bin is called after its first item
        return pd.DataFrame({"bin": frame["bin"], "parent": names[bins], "offset": offsets, "fill": fills[bins]})

    keyed = items.withColumn("lot", F.pmod(F.xxhash64("bin"), F.lit(groups)))
    return keyed.groupBy("lot").applyInPandas(pack, "bin bigint, parent bigint, offset bigint, fill bigint")


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end: int = END_ID, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    placed = saved(encoded_and_packed(pick(docs, doc_id=doc_id, text=text), tokenizer, capacity, end), "packed")
    # The piece at offset 0 stands for its bin.
    open_bins = placed.where((F.col("offset") == 0) & (F.col("fill") < capacity)).select("bin", "fill")
    moves: list[DataFrame] = []
    before = math.inf
    while True:
        least = open_bins.agg(F.min("fill")).first()[0]
        # A bin with less room than the smallest leftover is final.
        open_bins = open_bins.where(capacity - F.col("fill") >= F.lit(least))
        n = open_bins.count()
        if n < 2 or n > 0.99 * before:
            break
        groups = math.ceil(n / group_items)
        moves.append(saved(merge_round(open_bins, groups, capacity), "packed-round"))
        open_bins = moves[-1].where(F.col("offset") == 0).select(F.col("parent").alias("bin"), "fill")
        if groups == 1:
            break
        before = n
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if not moves:
        return placed.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    where = moves[0].select("bin", F.col("parent").alias("at"), F.col("offset").alias("shift"))
    for move in moves[1:]:
        step = move.select(F.col("bin").alias("at"), "parent", F.col("offset").alias("more"))
        where = where.join(step, "at", "left").select(
            "bin", F.coalesce("parent", "at").alias("at"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
    return placed.join(where, "bin", "left").select(
        *columns, F.coalesce("at", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
