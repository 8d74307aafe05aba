"""Token store: ids under one canonical, length-limited Huffman code, in independent blocks.

A store is a folder with two Parquet tables:

``codebook``  ``id, length``: code lengths, at most ``LONGEST`` bits, or two more than
              the occurring ids need (24 at most, so 4,194,304 ids). Codes are canonical:
              by length, then by id.
``chunks``    one row per run of whole documents in ascending id order: the
              document ids and token counts, the ``payload``, the byte at which
              each block of ``BLOCK`` ids begins in it, and ``lanes``: the bit
              offset in its block of every ``LANE``-th id.

A block begins at a byte and needs nothing from other blocks; a reader may enter it
at any lane, as ``read_span`` does. Decoding follows all lanes of a chunk at once: per step
one look-up of the next bits, as many as the longest code has, in a table that gives id and
length.

Documents are range-partitioned and sorted by id before they are encoded, so a
partition's files are a stretch of the order; one number per partition (its ids)
then places every document in the whole.

Defined results: a null text is an empty one and stores the end id alone; a null id
sorts first; rows with the same id are kept, in the order of the texts' hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import shared_path
from .frames import pick, sliced
from .tokens import crc32, encoder, with_end

LONGEST, WIDEST = 16, 24
BLOCK = 4096
LANE = 256
CHUNK = 1 << 18  # ids; a longer document is a chunk of its own
END_ID = 1


def longest_for(used: int) -> int:
    """Bits that codes may have when so many ids occur."""
    return max(LONGEST, int(used - 1).bit_length() + 2 if used > 1 else 1)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits, by package-merge; 0 for what does not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest or longest > WIDEST:
        raise ValueError(f"{len(used)} ids do not fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels = []  # per level: which of the merged list, in order, are leaves
    merged, is_leaf = weights, np.ones(len(weights), bool)
    levels.append(is_leaf)
    for _ in range(longest - 1):
        pairs = len(merged) // 2
        packages = merged[0:2 * pairs:2] + merged[1:2 * pairs:2]
        whole = np.concatenate([weights, packages])
        place = np.argsort(whole, kind="stable")
        merged, is_leaf = whole[place], place < len(weights)
        levels.append(is_leaf)
    take = 2 * (len(order) - 1)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, as a number of ``length`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    steps = np.cumsum(2.0 ** -lengths[order].astype(float))
    starts = np.concatenate([[0.0], steps[:-1]])
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = (starts * 2.0 ** lengths[order]).astype(np.int64)
    return codes


class Codec:
    """Code lengths made into an encoder and a decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.longest = lengths, max(LONGEST, int(lengths.max(initial=0)))
        self.codes = canonical(lengths)
        self._table = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Payload, first byte of each block, bit offset in its block of each lane."""
        if not len(ids):
            return b"", np.zeros(0, np.int32), np.zeros(0, np.int32)
        length = self.lengths[ids]
        ends = np.cumsum(length)
        starts = ends - length
        firsts = starts[::BLOCK]
        bits = np.diff(np.append(firsts, ends[-1]))
        taken = -(-bits // 8)
        blocks = np.cumsum(taken) - taken
        inside = starts - np.repeat(firsts, BLOCK)[:len(ids)]
        at = inside + np.repeat(blocks * 8, BLOCK)[:len(ids)]
        # Each code lies in a 32-bit word or two; the parts of a word have no bits in common, so they add up.
        word, shift = at >> 5, at & 31
        spread = self.codes[ids].astype(np.uint64) << (64 - length - shift).astype(np.uint64)
        total = int(blocks[-1] + taken[-1])
        words = np.zeros((total + 3) // 4 + 2, np.uint64)
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[begin]] += np.add.reduceat(spread >> np.uint64(32), begin)
        words[word[begin] + 1] += np.add.reduceat(spread & np.uint64(0xFFFFFFFF), begin)
        payload = words.astype(">u4").tobytes()[:total]
        return payload, blocks.astype(np.int64), inside[::LANE].astype(np.int32)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length by the next ``longest`` bits."""
        if self._table is None:
            used = np.flatnonzero(self.lengths)
            order = used[np.lexsort((used, self.lengths[used]))]
            width = 1 << (self.longest - self.lengths[order])
            ids, sizes = np.repeat(order, width), np.repeat(self.lengths[order], width)
            rest = (1 << self.longest) - len(ids)
            self._table = np.pad(ids, (0, rest)).astype(np.int64), np.pad(sizes, (0, rest)).astype(np.int64)
        return self._table

    def decode(self, payload: bytes, blocks: np.ndarray, lanes: np.ndarray, n: int, entry: int = 0) -> np.ndarray:
        """The last ids of ``n``, from lane ``entry`` on, every lane a step at a time."""
        ids, sizes = self.table()
        raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.int64)
        at = lanes.astype(np.int64) + np.repeat(blocks.astype(np.int64) * 8, BLOCK // LANE)[:len(lanes)]
        at, n = at[entry:], max(n - entry * LANE, 0)
        out = np.zeros((LANE, len(at)), np.uint32)
        shift = 24 - self.longest
        mask = (1 << self.longest) - 1
        full = n // LANE
        for step in range(LANE):
            if step == n - full * LANE and full < len(at):
                at = at[:full]  # the last lane is shorter
            byte = at >> 3
            window = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
            key = (window >> (shift - (at & 7))) & mask if shift >= 7 else \
                ((window << 8 | raw[byte + 3]) >> (shift + 8 - (at & 7))) & mask
            out[step, :len(at)] = ids[key]
            at = at + sizes[key]
        return out.T.ravel()[:n]


def encode_in_order(docs: DataFrame, tokenizer: str, end: int, path: str) -> DataFrame:
    """Each document's ids, written in order: ``part, seq, start, doc_id, n_tokens, ids``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spread = docs.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = (spread.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
               .select("doc_id", "text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for piece in sliced(batch, "text"):
                ids, bounds = with_end(*encoder(tokenizer)(piece.column("text")), end)
                n, sizes = piece.num_rows, np.diff(bounds)
                packed = ids.astype("<u2") if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else ids
                offsets = pa.py_buffer((bounds * packed.itemsize).astype(np.int32))
                column = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)),
                     pa.array(start + bounds[:-1]), piece.column("doc_id"), pa.array(sizes), column],
                    ["part", "seq", "start", "doc_id", "n_tokens", "ids"])
                seq, start = seq + n, start + int(bounds[-1])

    schema = f"part int, seq bigint, start bigint, doc_id {kind}, n_tokens bigint, ids binary"
    frame = ordered.mapInArrow(task, schema)
    frame.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(frame.schema).parquet(path)


def id_counts(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; a task sends one number per id it has seen."""
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            _, offsets, data = batch.column(0).buffers()
            bounds = np.frombuffer(offsets, np.int32)[batch.column(0).offset:][:batch.num_rows + 1]
            if batch.num_rows and bounds[-1] > bounds[0]:
                total += np.bincount(np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]].view(width), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(task, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    found = rows.toArrow()  # a row per id of the vocabulary at most
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return counts


_CHUNKS = ("part int, seq bigint, doc_ids array<{kind}>, starts array<bigint>, n_tokens array<bigint>, "
           "payload binary, blocks array<bigint>, lanes array<int>")


def write_store(docs: DataFrame, tokenizer: str, path: str, *, doc_id: str = "doc_id", text: str = "text",
                end: int = END_ID) -> str:
    """Encode all documents and write the store at ``path`` (a folder that all executors share)."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id=doc_id, text=text)
    encoded = encode_in_order(docs, tokenizer, end, shared_path(spark, "token-ids"))
    vocabulary = max(encoder(tokenizer).tokenizer.get_vocab_size(), end + 1)
    counts = id_counts(encoded, vocabulary)
    lengths = code_lengths(counts, longest_for(np.count_nonzero(counts)))
    used = np.flatnonzero(lengths)
    book = spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist())), "id bigint, length int")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(Codec(lengths))  # a row per id of the vocabulary
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(r["ids"] for r in held), width)
            payload, blocks, lanes = shared.value.encode(ids)
            row = {"part": held[0]["part"], "seq": held[0]["seq"], "doc_ids": [r["doc_id"] for r in held],
                   "starts": [r["start"] for r in held], "n_tokens": [r["n_tokens"] for r in held],
                   "payload": payload, "blocks": blocks, "lanes": lanes}
            return pa.RecordBatch.from_arrays(
                [pa.array([v], types[k]) for k, v in row.items()], list(row))

        types = None
        for batch in batches:
            types = {"part": pa.int32(), "seq": pa.int64(), "doc_ids": pa.list_(batch.schema.field("doc_id").type),
                     "starts": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int64()), "payload": pa.binary(),
                     "blocks": pa.list_(pa.int64()), "lanes": pa.list_(pa.int32())}
            for row in batch.to_pylist():
                follows = held and (row["part"], row["seq"]) == (held[-1]["part"], held[-1]["seq"] + 1)
                if held and (not follows or size + row["n_tokens"] > CHUNK):
                    yield chunk()
                    held, size = [], 0
                held.append(row)
                size += row["n_tokens"]
        if held:
            yield chunk()

    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded.mapInArrow(task, _CHUNKS.format(kind=kind)).write.option("compression", "none").parquet(f"{path}/chunks")
    return path


def read_store(spark, path: str) -> DataFrame:
    """The documents back from the files: ``doc_id, start, n_tokens, ids`` (ids as an array)."""
    return _decoded(spark, path, lambda ids: pa.array(ids, pa.list_(pa.int64())), "ids array<bigint>")


def digest(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document as the files hold it."""
    return _decoded(spark, path, lambda ids: pa.array([crc32(x) for x in ids], pa.int64()), "ids_crc32 bigint")


def read_span(spark, path: str, start: int, stop: int) -> DataFrame:
    """``start, ids``: the ids at places ``start`` to ``stop`` of the whole, in the runs that the chunks hold.

    Only chunks that reach into the span are decoded, from the lane that holds its first place.
    """
    codec, offsets, chunks = _opened(spark, path)
    spark_offsets = F.create_map(*[F.lit(x) for pair in offsets.value.items() for x in pair]) if offsets.value else F.create_map()
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    placed = chunks.withColumn("at", F.element_at("starts", 1) + F.coalesce(F.try_element_at(spark_offsets, F.col("part").cast("int")), F.lit(0)))
    wanted = placed.withColumn("n", total).where((F.col("at") < stop) & (F.col("at") + F.col("n") > start))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begin, end = max(start - row["at"], 0), min(stop - row["at"], row["n"])
                entry = begin // LANE
                ids = codec.value.decode(row["payload"], np.array(row["blocks"], np.int64), np.array(row["lanes"], np.int64), row["n"], entry)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["at"] + begin]), pa.array([ids[begin - entry * LANE:end - entry * LANE]], pa.list_(pa.int64()))],
                    ["start", "ids"])

    return wanted.select("at", "n", "payload", "blocks", "lanes").mapInArrow(task, "start bigint, ids array<bigint>")


def _opened(spark, path: str):
    """The broadcast codec, the broadcast number of ids before each partition, and the chunks of a store."""
    book = spark.read.parquet(f"{path}/codebook").toArrow()
    lengths = np.zeros(int(max(book.column("id").to_pylist(), default=0)) + 1, np.int64)
    lengths[book.column("id").to_numpy()] = book.column("length").to_numpy()
    chunks = spark.read.parquet(f"{path}/chunks")
    # One number per partition of the ordered documents.
    sizes = chunks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    sizes = sorted((r["part"], r["n"]) for r in sizes.collect())
    before = dict(zip((p for p, _ in sizes), itertools.accumulate((n for _, n in sizes), initial=0)))
    return spark.sparkContext.broadcast(Codec(lengths)), spark.sparkContext.broadcast(before), chunks


def _decoded(spark, path: str, made, column: str) -> DataFrame:
    shared, offsets, chunks = _opened(spark, path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                sizes = row["n_tokens"].values.to_numpy()
                ids = shared.value.decode(row["payload"].as_py(), row["blocks"].values.to_numpy(),
                                          row["lanes"].values.to_numpy(), int(sizes.sum()))
                starts = row["starts"].values.to_numpy() + offsets.value[row["part"].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(starts), pa.array(sizes),
                     made(np.split(ids, np.cumsum(sizes)[:-1]))], ["doc_id", "start", "n_tokens", column.split()[0]])

    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    return chunks.drop("seq").mapInArrow(task, f"doc_id {kind}, start bigint, n_tokens bigint, {column}")
