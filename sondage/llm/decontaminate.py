"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text.

A text is normalised to its words (ASCII letters in lower case, digits, anything
beyond ASCII). The items' distinct words are numbered and a text becomes a string of
these numbers, one sentinel for every other word, so a match always covers whole
words. Any ``WINDOW`` consecutive words of an item contain one of its blocks of
``(WINDOW + 1) // 2`` words that begin at multiples of that length; these blocks, and
items shorter than a window as they are, are the patterns. So the automaton has about a
node per word of the benchmark, however many windows that has. Where a block occurs, the
match is followed to both sides along the item; a run of a window or more is a hit, as
all windows in it occur. Hits are mapped back to word numbers and to characters.

The items are broadcast, up to ``BLOCK_BYTES`` of text (16 MB take about 300 MB in a
worker). A larger benchmark is matched in blocks of that size, each by a scan of a
numbered table of the texts, of which later blocks return hits only.

Defined results: a null or wordless text has no words and no hits; a null or
wordless item has no windows; items without an id are left out; rows of the same
item id count once; documents are judged row by row, whatever their ids.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .frames import column, map_slices, pick, saved, text_buffer

WINDOW = 13
BLOCK_BYTES = 16 << 20
_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[48:58] = np.arange(48, 58)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)

SPAN = "struct<first:bigint,stop:bigint,start_char:bigint,stop_char:bigint>"
_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "stop", "start_char", "stop_char")]))


def joined_words(normal: np.ndarray) -> str:
    """Words of normalised bytes with one space between. Cut as bytes: str.split() counts 85 and A0, parts of characters, as white space."""
    return b" ".join(normal.tobytes().split()).decode("latin-1")


def item_words(text: str | None) -> list[str]:
    """The normalised words of one item; bytes beyond ASCII stay as they are, one character each."""
    joined = joined_words(_NORMAL[np.frombuffer((text or "").encode(), np.uint8)])
    return joined.split(" ") if joined else []


class Items:
    """The patterns of a benchmark and where each occurs in its items."""

    #: Characters that stand for word numbers; 0 is every word that no item has. Surrogates are left out.
    SIGNS = 0x110000 - 0x800 - 1

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        import ahocorasick

        words = [(item, item_words(text)) for item, text in items]
        known = sorted({w for _, held in words for w in held})
        self.window = window
        self.width = 1 if len(known) < self.SIGNS else 2
        self.signs = {w: self._sign(k + 1) for k, w in enumerate(known)}
        self.other = self._sign(0)
        self.names: list[str] = []
        self.texts: list[str] = []
        places: dict[str, list[tuple[int, int]]] = {}
        block = (window + 1) // 2
        for item, held in words:
            if not held:
                continue
            number = len(self.names)
            self.names.append(item)
            text = "".join(map(self.signs.__getitem__, held))
            self.texts.append(text)
            if len(held) < window:
                places.setdefault(text, []).append((number, 0))
            else:
                for start in range(0, len(held) - block + 1, block):
                    places.setdefault(text[start * self.width:(start + block) * self.width], []).append((number, start))
        self.machine = ahocorasick.Automaton()
        for pattern, found in places.items():
            self.machine.add_word(pattern, (len(pattern) // self.width, found))
        self.empty = not places
        if places:
            self.machine.make_automaton()

    def _sign(self, number: int) -> str:
        digits = [number] if self.width == 1 else divmod(number, self.SIGNS)
        return "".join(chr(d if d < 0xD800 else d + 0x800) for d in digits)

    def runs(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(first, stop, item) of the runs of words that windows of items cover, in any order; each run once."""
        width, other = self.width, self.other
        text = "".join([self.signs.get(w, other) for w in words])
        found: set[tuple[int, int, int]] = set()
        done: dict[tuple[int, int], int] = {}  # how far the run of an item on a diagonal has been followed
        for end, (size, places) in self.machine.iter(text):
            if (end + 1) % width:
                continue
            stop = (end + 1) // width
            first = stop - size
            for item, start in places:
                line = self.texts[item]
                if len(line) < self.window * width:
                    found.add((first, stop, item))
                    continue
                if done.get((item, first - start), -1) >= stop:
                    continue
                a, b = first, stop
                while a and a - first + start > 0 and self._same(text, a - 1, line, a - 1 - first + start):
                    a -= 1
                most = min(len(words), len(line) // width + first - start)
                while b < most and self._same(text, b, line, b - first + start):
                    b += 1
                done[item, first - start] = b
                if b - a >= self.window:
                    found.add((a, b, item))
        return list(found)

    def _same(self, text: str, place: int, line: str, other: int) -> bool:
        width = self.width
        return text[place * width:(place + 1) * width] == line[other * width:(other + 1) * width]


class Scanner:
    """Scans slices of texts for one block of items. Sent to the tasks; builds its automaton there, once a worker."""

    _built: dict[str, Items] = {}

    def __init__(self, shared, name: str, window: int):
        self.shared, self.name, self.window = shared, name, window

    def items(self) -> Items:
        if self.name not in self._built:
            self._built.clear()
            self._built[self.name] = Items(self.shared.value, self.window)
        return self._built[self.name]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
        """Number of words, merged hit spans and found items of each text."""
        known = self.items()
        raw, offsets = text_buffer(texts)
        normal = _NORMAL[raw]
        solid = normal != 32
        begin = solid.copy()
        if len(raw):
            begin[1:] &= ~solid[:-1]
        inner = offsets[:-1][offsets[:-1] < len(raw)]
        begin[inner] = solid[inner]
        total = np.concatenate([[0], np.cumsum(begin, dtype=np.int64)])
        n_words = total[offsets[1:]] - total[offsets[:-1]]
        spans: list[list[dict]] = [[] for _ in n_words]
        items: list[list[str]] = [[] for _ in n_words]
        if known.empty:
            return n_words, spans, items
        for i in np.flatnonzero(n_words):
            a, b = offsets[i], offsets[i + 1]
            found = known.runs(joined_words(normal[a:b]).split(" "))
            if found:
                spans[i] = self._mapped(found, raw[a:b], solid[a:b], begin[a:b])
                items[i] = sorted({known.names[item] for _, _, item in found})
        return n_words, spans, items

    @staticmethod
    def _mapped(found, raw, solid, begin) -> list[dict]:
        starts = np.flatnonzero(begin)
        last = np.append(~solid[1:], True) & solid
        stops = np.flatnonzero(last) + 1
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, [first for first, _, _ in found], 1)
        np.add.at(change, [stop for _, stop, _ in found], -1)
        hit = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return [{"first": int(x), "stop": int(y), "start_char": int(chars[starts[x]]), "stop_char": int(chars[stops[y - 1]])}
                for x, y in zip(edges[::2], edges[1::2])]


def item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The items in blocks of about ``block_bytes`` of text each."""
    items = pick(benchmark, item=item, text=text).where("item is not null and text is not null")
    items = items.select(F.col("item").cast("string").alias("item"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    place = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    return [items.where(place == b) if blocks > 1 else items for b in range(blocks)]


def find_items(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: ``doc_id, n_words, spans, items``.

    ``spans`` are the merged runs of hit words, first to stop in word numbers and
    in characters of the text; ``items`` the sorted ids of the items found.
    """
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    source = pick(docs, doc_id=doc_id, text=text)
    if len(blocks) > 1:  # numbered once: every block's scan reads the same numbers
        source = saved(source.withColumn("_row", F.monotonically_increasing_id()), "numbered-texts")
    keys = [name for name in source.columns if name != "text"]
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "stop", "start_char", "stop_char")])
    schema = T.StructType([*[source.schema[n] for n in keys], T.StructField("n_words", T.LongType()),
                           T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType()))])
    parts = []
    for block in blocks:
        held = sorted({(r["item"], r["text"]) for r in block.collect()})  # at most ``block_bytes`` and one item
        scan = Scanner(spark.sparkContext.broadcast(held), uuid.uuid4().hex, window)

        def work(batch: pa.RecordBatch, scan=scan) -> pa.RecordBatch:
            n_words, spans, items = scan(batch.column("text"))
            return pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], pa.array(n_words), pa.array(spans, _SPANS),
                 pa.array(items, pa.list_(pa.string()))], [*keys, "n_words", "spans", "items"])

        parts.append(map_slices(source, "text", work, schema))
    if len(parts) == 1:
        return parts[0]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part.where(F.size("items") > 0))
    # One row per document and block: groups are as small as the number of blocks.
    merged = whole.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("doc_id", "n_words", merged_spans("spans").alias("spans"), "items")


def merged_spans(spans: str) -> Column:
    """Sorted spans with those that overlap or touch made one."""
    def step(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["stop"], span["stop"]).alias("stop"),
                          last["start_char"].alias("start_char"),
                          F.greatest(last["stop_char"], span["stop_char"]).alias("stop_char"))
        return (F.when(F.size(done) == 0, F.array(span))
                .when(span["first"] > last["stop"], F.concat(done, F.array(span)))
                .otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))))

    return F.aggregate(spans, F.expr(f"cast(array() as array<{SPAN}>)"), step)


def hit_words(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, span: n + span["stop"] - span["first"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty lies in a window of a test item."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that are not contaminated, with their own columns only.

    The row itself travels as the id, so nothing is joined back.
    """
    carried = docs.select(F.struct(*[column(n) for n in docs.columns]).alias("row"), column(text).alias("text"))
    found = find_items(carried, benchmark, doc_id="row", item_id=item_id, item_text=item_text, window=window,
                       block_bytes=block_bytes)
    clean = found.where(~is_contaminated(hit_words("spans"), F.col("n_words")))
    return clean.select("doc_id.*")
