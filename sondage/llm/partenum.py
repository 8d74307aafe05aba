"""Jaccard join of shingle sets by PartEnum signatures, and its connected components.

A text's set holds the hashes of its distinct 3-word shingles. Sets fall into size
bands whose ends are the similarity apart; a set signs for its own band and the
next, so two similar sets always sign for one band together. In a band, similar sets
differ in at most ``k`` elements: the domain is partitioned by hash into ``n1``
parts, so one part has at most ``k2`` differences; that part is partitioned again into
``n2``, and each choice of ``n2 - k2`` of these gives a signature, one of which is free
of differences. Up to ``ENUMERATED`` differences (sets of 37 elements at 0.9, of 17 at 0.8) choices
are enumerated; above, ``n1 = k + 1`` and the choice is one part. Choosing two of three parts
there too was measured (README): half as many signatures again, about as many shared ones.

Equal sets are one class from the start. Classes that share a signature form a bucket,
which is resolved in two rounds. First its members are gathered around centres: each is
paired with the first centre it may be similar to, and the pairs are verified. That
joins what belongs together with as many pairs as there are members, not their square.
Then those pairs of members that may be similar and are still in different components
are verified too; no link is left out. Inside a task "may be similar" is decided on
sizes and on parity sketches, which never differ in more cells than the sets differ in
elements; pairs that fail are never emitted. A bucket of more than ``BLOCK`` members is
compared block by block, in tasks of their own.

Defined results: a null or wordless text has the empty set and links with nothing
(its component is its own id); a text of one or two words is one shingle; rows with
the same id or none are documents of their own; a null id is no component's name
unless nothing else is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..ordering import Lookup, lookup_join
from .components import components
from .frames import column, map_slices, pick, saved, text_buffer

WORDS = 3
NUMERATOR, DENOMINATOR = 9, 10  # similarity of at least 9 / 10
ENUMERATED = 3  # up to this many differences, choices of parts are enumerated over the whole set
SPARE = 2
BROADCAST_BYTES = 32 << 20
BLOCK = 4096
FEW = 16  # members up to which a bucket is compared pair by pair on whole numbers rather than on arrays
SENT = 1 << 16  # pairs a task gathers before it sends them on
LEAST_CELLS, MOST_CELLS = 1 << 10, 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                              for b in (_BASE, _INVERSE))
    return _POWERS[size]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, words: int = WORDS, seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = text_buffer(texts)
    if not len(raw):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    low = _LOWER[raw]
    solid = ~_SPACE[raw]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    stops = np.flatnonzero(solid & (~after | edge[1:])) + 1
    power, inverse = _powers(len(low) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * power[:len(low)], dtype=np.uint64)])
    hashes = _mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64) + np.uint64(seed))
    factors = [_mix(np.full(1, 11 + k, np.uint64))[0] | np.uint64(1) for k in range(words)]
    total = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k, factor in enumerate(factors):
        total += _mix(hashes[k:len(hashes) - words + 1 + k] * factor) if len(total) else total
    total = _mix(total)
    first = np.searchsorted(starts, offsets)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(total[a:b - words + 1]))
        elif b > a:
            short = sum((_mix(hashes[a + k:a + k + 1] * factors[k]) for k in range(b - a)), np.zeros(1, np.uint64))
            out.append(_mix(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bands(numerator: int, denominator: int, largest: int) -> list[int]:
    """First size of each band: [first, next) spans at most the similarity."""
    firsts = [1]
    while firsts[-1] <= largest:
        firsts.append(firsts[-1] * denominator // numerator + 1)
    return firsts


_BANDS: dict[tuple[int, int], np.ndarray] = {}


def signatures(elements: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> np.ndarray:
    """The signatures of one set, as 64-bit hashes."""
    n = len(elements)
    if not n:
        return np.zeros(0, np.uint64)
    key = (numerator, denominator)
    if key not in _BANDS or _BANDS[key][-2] <= n * 2:
        _BANDS[key] = np.array(bands(numerator, denominator, 4 * n + 1000))
    firsts = _BANDS[key]
    own = int(np.searchsorted(firsts, n, "right")) - 1
    found = []
    place = _mix(elements + np.uint64(0x5851F42D4C957F2D))
    with np.errstate(over="ignore"):
        for band in (own, own + 1):
            last = int(firsts[band + 1]) - 1  # largest size that signs here
            k = 2 * last * (denominator - numerator) // (denominator + numerator)
            name = _mix(np.full(1, band + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
            if k <= ENUMERATED:
                n1, n2, k2 = 1, k + SPARE if k else 1, k
            else:
                n1, n2, k2 = k + 1, 1, 0
            part = (place % np.uint64(n1 * n2)).astype(np.int64)
            order = np.bincount(part, minlength=n1 * n2) > 0
            sums = np.zeros(n1 * n2, np.uint64)
            np.add.at(sums, part, _mix(elements ^ name))
            sums = np.where(order, sums, np.uint64(0))
            if n2 == 1:
                found.append(_mix(sums + _mix(np.arange(n1, dtype=np.uint64) + name)))
            else:
                grid = sums.reshape(n1, n2)
                for number, chosen in enumerate(combinations(range(n2), n2 - k2)):
                    tagged = sum((_mix(grid[:, c] + np.uint64(c + 1)) for c in chosen), np.zeros(n1, np.uint64))
                    found.append(_mix(tagged + _mix(np.arange(n1, dtype=np.uint64) * np.uint64(977) + np.uint64(number) + name)))
    return np.unique(np.concatenate(found))


def fingerprint(elements: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that name the set."""
    if not len(elements):
        return 0, 0
    first = _mix(elements + np.uint64(3)).sum(dtype=np.uint64) + np.uint64(len(elements))
    second = _mix(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(np.array([first]).view(np.int64)[0]), int(np.array([second]).view(np.int64)[0])


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parity of the elements in each cell: no more cells differ than elements do.

    Five cells or more for eight elements: unlike sets then differ in half of the cells, more than the 2 / 9 of an
    element each that similar ones may at 0.8. A bucket's rows carry their sketches, so twice as many are most of the shuffle.
    """
    cells = 1 << int(np.clip((max(len(elements) * 5 // 8, 1) - 1).bit_length(), LEAST_CELLS.bit_length() - 1, MOST_CELLS.bit_length() - 1))
    odd = np.bincount((_mix(elements + np.uint64(77)) % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set in fewer cells."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def few_pairs(rows: list[tuple], numerator: int, denominator: int, star: bool) -> list[tuple[int, int]]:
    """What ``Bucket`` finds, for a handful of members, without arrays."""
    rows.sort(key=lambda r: (r[3], r[0]))
    cells = min(len(r[2]) for r in rows) * 8
    members = []
    for cls, n, held, block, root in rows:
        bits, width = int.from_bytes(held, "little"), len(held) * 8
        while width > cells:
            width //= 2
            bits = (bits >> width) ^ (bits & ((1 << width) - 1))
        members.append((cls, n, bits, block, root))

    def near(x: tuple, y: tuple) -> bool:
        low, high = (x[1], y[1]) if x[1] < y[1] else (y[1], x[1])
        return denominator * low >= numerator * high and (
            (denominator + numerator) * (x[2] ^ y[2]).bit_count() <= (denominator - numerator) * (low + high))

    found = []
    if star:
        while len(members) > 1:
            centre, rest = members[0], []
            for other in members[1:]:
                if near(centre, other):
                    found.append((centre[0], other[0]))
                else:
                    rest.append(other)
            members = rest
        return found
    across = members[0][3] != members[-1][3]
    for i, x in enumerate(members):
        for y in members[i + 1:]:
            if x[4] != y[4] and not (across and x[3] == y[3]) and near(x, y):
                found.append((x[0], y[0]))
    return found


class Bucket:
    """Members of one bucket, or of two of its blocks, with what decides whether two may be similar."""

    def __init__(self, rows: list[tuple], numerator: int, denominator: int):
        rows.sort(key=lambda r: (r[3], r[0]))
        self.cls = np.array([r[0] for r in rows], np.int64)
        self.n = np.array([r[1] for r in rows], np.int64)
        words = min(len(r[2]) for r in rows) // 8
        self.sketch = np.array([folded(np.frombuffer(r[2], np.uint64), words) for r in rows])
        self.block = np.array([r[3] for r in rows])
        self.root = np.array([r[4] for r in rows], np.int64)
        self.num, self.den = numerator, denominator

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the others may be similar to this one."""
        cells = np.bitwise_count(self.sketch[others] ^ self.sketch[one]).sum(axis=1, dtype=np.int64)
        sizes = self.n[others]
        return ((self.den + self.num) * cells <= (self.den - self.num) * (sizes + self.n[one])) & (
            self.den * np.minimum(sizes, self.n[one]) >= self.num * np.maximum(sizes, self.n[one]))

    def stars(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(centre, members): each member once, with the first centre it may be similar to."""
        found, rest = [], np.arange(len(self.cls))
        while len(rest) > 1:
            centre, rest = rest[0], rest[1:]
            near = self.near(centre, rest)
            if near.any():
                found.append((np.full(near.sum(), self.cls[centre]), self.cls[rest[near]]))
            rest = rest[~near]
        return found

    def apart(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs that may be similar and are in different components; of two blocks, pairs across."""
        found = []
        split = int(np.searchsorted(self.block, self.block[-1])) if self.block[0] != self.block[-1] else 0
        for one in range(split or len(self.cls)):
            rest = np.arange(max(split, one + 1), len(self.cls))
            rest = rest[self.root[rest] != self.root[one]]
            if len(rest):
                near = self.near(one, rest)
                if near.any():
                    found.append((np.full(near.sum(), self.cls[one]), self.cls[rest[near]]))
        return found


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """The frame, to be broadcast if its rows are counted to fit; else a shuffled join takes its place."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


class Join:
    """One run of the join over a table of documents."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, numerator: int, denominator: int, words: int, seed: int):
        self.source = pick(docs, doc_id=doc_id, text=text).withColumn("text_hash", F.xxhash64("text"))
        self.numerator, self.denominator, self.words, self.seed = numerator, denominator, words, seed
        self.kind = self.source.schema["doc_id"].dataType.simpleString()

    def documents(self) -> DataFrame:
        """``doc_id, text_hash, n, cls, other`` of every row."""
        words, seed = self.words, self.seed

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column("text"), words, seed)
            names = [fingerprint(s) for s in sets]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([x for x, _ in names], pa.int64()), pa.array([y for _, y in names], pa.int64())],
                ["doc_id", "text_hash", "n", "cls", "other"])

        frame = map_slices(self.source, "text", work, f"doc_id {self.kind}, text_hash bigint, n bigint, cls bigint, other bigint")
        return saved(frame, "shingle-classes")

    def signed(self) -> DataFrame:
        """``sig, cls`` of every row."""
        words, seed, num, den = self.words, self.seed, self.numerator, self.denominator

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = {fingerprint(s)[0]: s for s in shingle_sets(batch.column("text"), words, seed) if len(s)}
            signs = [signatures(s, num, den).view(np.int64) for s in found.values()]
            names = np.repeat(np.fromiter(found, np.int64, len(found)), [len(s) for s in signs])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.int64), *signs])), pa.array(names)], ["sig", "cls"])

        return map_slices(self.source, "text", work, "sig bigint, cls bigint")

    def buckets(self) -> DataFrame:
        """``sig, cls`` of signatures that at least two classes share, each once, with its ``block`` of the bucket, their
        number ``blocks`` and the bucket's ``size``."""
        signed = self.signed()
        ends = Window.partitionBy("sig")
        shared = signed.withColumns({"lo": F.min("cls").over(ends), "hi": F.max("cls").over(ends)}).where("lo != hi")
        # One shuffle by signature serves all: what is saved here is not dealt by signature again.
        placed = shared.select("sig", "cls").distinct().withColumns({
            "block": F.floor((F.row_number().over(ends.orderBy("cls")) - 1) / BLOCK).cast("int"),
            "size": F.count(F.lit(1)).over(ends)})
        return saved(placed.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "shared-signatures")

    def sets(self, classes: DataFrame, members: DataFrame) -> DataFrame:
        """``cls, n, elements, sketch`` of the given classes, one row of each, from one document of each."""
        words, seed = self.words, self.seed
        wanted = members.join(classes, "cls", "left_semi")
        chosen = wanted.groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"))
        ids = saved(chosen.select("cls", F.col("at.doc_id").alias("rep"), F.col("at.text_hash").alias("rep_hash")), "set-documents")
        size = ids.agg(F.sum(F.coalesce(F.octet_length(F.col("rep").cast("string")), F.lit(0)) + 48)).first()[0] or 0
        same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))
        picked = ids.select("rep", "rep_hash")
        docs = self.source.join(F.broadcast(picked) if size <= BROADCAST_BYTES else picked, same, "left_semi")

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [s for s in shingle_sets(batch.column("text"), words, seed) if len(s)]
            return pa.RecordBatch.from_arrays(
                [pa.array([fingerprint(s)[0] for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()),
                 pa.array([s.tobytes() for s in found], pa.binary()),
                 pa.array([sketch(s).tobytes() for s in found], pa.binary())], ["cls", "n", "elements", "sketch"])

        frame = map_slices(docs.select("text"), "text", work, "cls bigint, n bigint, elements binary, sketch binary")
        rows = members.join(picked, same, "left_semi").count()
        # Rows of one id and text are all chosen; their class is kept once.
        return saved(frame if rows == ids.count() else frame.dropDuplicates(["cls"]), "shingle-sets")

    def candidates(self, rows: DataFrame, star: bool) -> DataFrame:
        """Pairs (a, b), a below b, of bucket rows with their sketches and components, and the ``sig`` of every bucket
        that has any, in rows of its own."""
        num, den = self.numerator, self.denominator
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
        spread = rows.withColumn("other", F.explode(others)).select(
            "sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            "cls", "n", "sketch", "block", "root")
        dealt = spread.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")

        def pairs(held: list[tuple]) -> np.ndarray:
            if not star and len({row[4] for row in held}) == 1:
                return np.zeros((0, 2), np.int64)
            if len(held) <= FEW:
                return np.array(few_pairs(held, num, den, star), np.int64).reshape(-1, 2)
            bucket = Bucket(held, num, den)
            found = bucket.stars() if star else bucket.apart()
            return np.concatenate([np.zeros((0, 2), np.int64), *[np.column_stack(f) for f in found]])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, found, live, waiting = None, [], [], [], 0

            def sent() -> pa.RecordBatch:
                both = np.concatenate([np.zeros((0, 2), np.int64), *found])
                both = np.unique(np.sort(both, axis=1), axis=0)
                sigs = np.unique(np.array(live if star else [], np.int64))
                none, gap = np.zeros(len(sigs), np.int64), np.zeros(len(both), bool)
                pair = np.concatenate([gap, np.ones(len(sigs), bool)])  # rows without a pair
                return pa.RecordBatch.from_arrays(
                    [*[pa.array(np.concatenate([both[:, k], none]), mask=pair) for k in (0, 1)],
                     pa.array(np.concatenate([np.zeros(len(both), np.int64), sigs]), mask=~pair)], ["a", "b", "sig"])

            for batch in batches:
                keys = zip(*[batch.column(n).to_numpy().tolist() for n in ("sig", "i", "j")])
                values = zip(*[batch.column(n).to_numpy(zero_copy_only=False).tolist()
                               for n in ("cls", "n", "sketch", "block", "root")])
                for this, value in zip(keys, values):
                    if this != key:
                        if len(held) > 1:
                            found.append(pairs(held))
                            waiting += len(found[-1])
                            if len(found[-1]):
                                live.append(key[0])
                            else:
                                found.pop()
                        if waiting > SENT:
                            yield sent()
                            found, live, waiting = [], [], 0
                        key, held = this, []
                    held.append(value)
            if len(held) > 1:
                found.append(pairs(held))
                if len(found[-1]):
                    live.append(key[0])
            yield sent()

        return dealt.mapInArrow(task, "a bigint, b bigint, sig bigint").distinct()

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough."""
        num, den = self.numerator, self.denominator
        left = sets.select(F.col("cls").alias("a"), F.col("elements").alias("set_a"))
        right = sets.select(F.col("cls").alias("b"), F.col("elements").alias("set_b"))
        firsts = left.join(_small(pairs.select("a").distinct(), 16), "a", "left_semi")
        both = right.join(_small(pairs, 32), "b").join(firsts, "a").select("a", "b", "set_a", "set_b")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(den * common >= num * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return saved(both.mapInArrow(task, "a bigint, b bigint"), "links")

    def rooted(self, members: DataFrame) -> DataFrame:
        """``cls, root``: the component of every class that has a link."""
        placed = self.buckets()
        sets = self.sets(placed.select("cls").distinct(), members)
        sketches = sets.select("cls", "n", "sketch")
        found = saved(self.candidates(placed.join(sketches, "cls").withColumn("root", F.col("cls")), star=True), "pairs")
        first = found.where("a is not null").select("a", "b")
        links = self.verified(first, sets)
        roots = saved(components(links).select(F.col("node").alias("cls"), "root"), "roots")
        # Of two members, and where it found no pair, the first round has compared all there is.
        live = found.where("sig is not null").select("sig").distinct()
        left = placed.where("size > 2").join(live, "sig", "left_semi").join(sketches, "cls")
        known = left.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        rest = saved(self.candidates(known, star=False).select("a", "b").join(first, ["a", "b"], "left_anti"), "pairs")
        more = self.verified(rest, sets)
        if more.isEmpty():
            return roots
        return components(links.unionByName(more)).select(F.col("node").alias("cls"), "root")


def _components(docs: DataFrame, doc_id: str, text: str, numerator: int, denominator: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, text_hash, n, cls) and, of each class with words, ``cls, component_id, first_hash``.

    The first of a component is the row with the smallest id, no id last, then the smallest text hash.
    """
    seed = 0
    while True:
        run = Join(docs, doc_id, text, numerator, denominator, words, seed)
        members = run.documents()
        mixed = members.groupBy("cls").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x != y")
        if mixed.isEmpty():  # else two different sets share a 64-bit name: take other hashes
            break
        seed += 1
    full = members.where("n > 0")
    roots = run.rooted(full)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = full.groupBy("cls").agg(first.alias("first")).join(roots, "cls", "left")
    classes = saved(classes.withColumn("root", F.coalesce("root", "cls")), "classes")
    least = classes.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    sums = least.agg(F.count(F.lit(1)), F.sum("n")).first()
    # A component may hold very many classes: its root is then a hot key of this look-up.
    named = lookup_join(classes.select("cls", "root"), Lookup(least, sums[0], sums[1] or 0), F.col("root"), "root", ["least"])
    return members, saved(named.select("cls", F.col("least.doc_id").alias("component_id"),
                                       F.col("least.text_hash").alias("first_hash")), "class-components")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", numerator: int = NUMERATOR,
                    denominator: int = DENOMINATOR, words: int = WORDS) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``. Similarity is at least numerator / denominator."""
    members, named = _components(docs, doc_id, text, numerator, denominator, words)
    return members.join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", numerator: int = NUMERATOR,
             denominator: int = DENOMINATOR, words: int = WORDS) -> DataFrame:
    """One row of each component, the first by id (none last), then text hash, with its own columns only.

    Rows without words are not copies of anything and stay. Of rows with the same id and
    text one stays, that with the smallest hash of all its columns.
    """
    members, named = _components(docs, doc_id, text, numerator, denominator, words)
    held = members.where("n > 0").join(named, "cls")
    rows = held.groupBy("doc_id", "text_hash").agg(
        F.min((F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))).cast("int")).alias("stays"),
        F.count(F.lit(1)).alias("n"))
    odd = saved(rows.where("stays = 0 or n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stays"), "copies")
    size = odd.agg(F.sum(F.coalesce(F.octet_length(F.col("_id").cast("string")), F.lit(0)) + 32)).first()[0] or 0
    marks = F.broadcast(odd) if size <= BROADCAST_BYTES else odd
    whole = docs.select(F.struct(*[column(n) for n in docs.columns]).alias("_row"), column(doc_id).alias("_doc"),
                        F.xxhash64(column(text)).alias("_text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    single = whole.join(marks, same, "left_anti").select("_row.*")
    if odd.where("stays = 1").isEmpty():
        return single
    repeated = whole.join(F.broadcast(odd.where("stays = 1")) if size <= BROADCAST_BYTES else odd.where("stays = 1"), same, "left_semi")
    one = repeated.groupBy("_doc", "_text").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return single.unionByName(one.select("_row.*"))
