"""Main text of web pages by wrapper induction over the pages of a host.

Every page becomes a tree of block elements. One page of a host is its pivot, the one with
the most different kinds of elements and of these the smallest, and every page of the host
is aligned with it by simple tree matching: the largest mapping that keeps labels, levels
and order. Mapped places are the wrapper's slots. Over all pages of the host a slot's texts
are counted once per title, so that copies of a page do not vouch for each other. Where one
text fills a slot of nearly all titles, it is template and goes from every page that has it;
slots whose texts vary are content.

Constancy cannot tell a varying advert or menu from an article, nor an article that a host
has only copies of from a template. So elements that are by name, role, class or id a menu,
header, footer, sidebar, notice, advert, form or comment are left out, whatever they hold;
inside an ``article`` or ``main`` more titles have to agree before a text is template; and a
page that the template would take more than four fifths of is a copy and keeps its text.
On pages without such an element the text is what lies in the smallest element that holds
two thirds of the unlinked text left, without lists of links, and the first heading.

Hosts are counted whole. What is shuffled is outlines: labels and hashes, not pages. Pages
meet their template marks by a hash of url and html, in a broadcast if the marks are small.

Defined results: a null html is empty, a page without text gives an empty string; pages
without a host, and the only page of one, have no template; equal rows and equal page ids
are rows of their own; other columns are ignored; elements more than 200 levels deep are
aligned as if at that level (their text is kept).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .dom import Page
from .frames import map_slices, pick, saved
from .urlrules import host

#: Titles that must agree, and their share of those that have the slot: outside of article and main, and inside.
OUTSIDE, INSIDE = (3, 0.9), (8, 0.95)
REGION = 2 / 3  # of a page's unlinked text, where no element says which is the article
BROADCAST_BYTES = 32 << 20
COPY = 0.8  # a page with more of its text in template than this is a copy of other pages
CELLS = 1 << 20  # cells of a table of two lists of children; longer lists are halved first
KNOWN = 1 << 18  # kinds of subtrees, or pairs of them, that a task remembers

Kind = int


class Matcher:
    """Simple tree matching; equal subtrees, and pairs of kinds seen before, are scored once."""

    def __init__(self):
        self.kinds: dict[tuple, Kind] = {}
        self.parts: list[tuple] = []
        self.sizes: list[int] = []
        self.scores: dict[tuple[Kind, Kind], int] = {}

    def tree(self, nodes: list[tuple[int, str]]) -> tuple[list[list[int]], list[Kind]]:
        """Children and kind of each node of a list of (level, label) in page order."""
        if len(self.kinds) > KNOWN or len(self.scores) > 4 * KNOWN:
            self.__init__()
        children: list[list[int]] = [[] for _ in nodes]
        path: list[int] = []
        for node, (level, _) in enumerate(nodes):
            del path[level:]
            if path:
                children[path[-1]].append(node)
            while len(path) < level:
                path.append(path[-1])
            path.append(node)
        kinds = [0] * len(nodes)
        for node in range(len(nodes) - 1, -1, -1):
            key = (nodes[node][1], *[kinds[c] for c in children[node]])
            if key not in self.kinds:
                self.kinds[key] = len(self.parts)
                self.parts.append(key)
                self.sizes.append(1 + sum(self.sizes[k] for k in key[1:]))
            kinds[node] = self.kinds[key]
        return children, kinds

    def score(self, a: Kind, b: Kind) -> int:
        """Nodes that the best mapping of two subtrees pairs."""
        if a == b:
            return self.sizes[a]
        one, two = self.parts[a], self.parts[b]
        if one[0] != two[0]:
            return 0
        if (a, b) not in self.scores:
            self.scores[a, b] = 1 + self._lists(one[1:], two[1:])
        return self.scores[a, b]

    @staticmethod
    def _ends(a: list[Kind] | tuple, b: list[Kind] | tuple) -> tuple[int, int]:
        """How many equal subtrees both lists begin and end with; pairing these is always best."""
        most, front, back = min(len(a), len(b)), 0, 0
        while front < most and a[front] == b[front]:
            front += 1
        while back < most - front and a[-1 - back] == b[-1 - back]:
            back += 1
        return front, back

    def _weights(self, a, b) -> np.ndarray:
        first, at = np.unique(np.array(a, np.int64), return_inverse=True)
        second, to = np.unique(np.array(b, np.int64), return_inverse=True)
        table = np.array([[self.score(x, y) for y in second.tolist()] for x in first.tolist()], np.int64)
        return table.reshape(len(first), len(second))[at][:, to]

    def _row(self, weights_of, rows, width: int) -> np.ndarray:
        last = np.zeros(width + 1, np.int64)
        for place in rows:
            last[1:] = np.maximum.accumulate(np.maximum(last[1:], last[:-1] + weights_of(place)))
        return last

    def _lists(self, a, b) -> int:
        front, back = self._ends(a, b)
        total = sum(self.sizes[k] for k in a[:front]) + sum(self.sizes[k] for k in a[len(a) - back:])
        a, b = a[front:len(a) - back], b[front:len(b) - back]
        if not a or not b:
            return total
        if len(a) == 1 or len(b) == 1:
            return total + max(self.score(x, y) for x in set(a) for y in set(b))
        rows = {k: self._weights([k], b)[0] for k in set(a)}
        return total + int(self._row(lambda i: rows[a[i]], range(len(a)), len(b))[-1])

    def _pairs(self, a, b) -> list[tuple[int, int]]:
        """Places in two lists of kinds that the best mapping pairs."""
        front, back = self._ends(a, b)
        out = [(i, i) for i in range(front)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(back)]
        x, y = a[front:len(a) - back], b[front:len(b) - back]
        if x and y:
            out += [(i + front, j + front) for i, j in self._middle(x, y)]
        return out

    def _middle(self, a, b) -> list[tuple[int, int]]:
        if len(a) == 1:
            scores = self._weights(a, b)[0]
            return [(0, int(scores.argmax()))] if scores.max() > 0 else []
        if len(a) * len(b) > CELLS:  # linear memory: halve one list, cut the other where both halves give most
            half = len(a) // 2
            rows = {k: self._weights([k], b)[0] for k in set(a)}
            up = self._row(lambda i: rows[a[i]], range(half), len(b))
            down = self._row(lambda i: rows[a[i]][::-1], range(len(a) - 1, half - 1, -1), len(b))[::-1]
            cut = int((up + down).argmax())
            return ([p for p in (self._pairs(a[:half], b[:cut]) if cut else [])]
                    + [(i + half, j + cut) for i, j in (self._pairs(a[half:], b[cut:]) if cut < len(b) else [])])
        weights = self._weights(a, b)
        table = np.zeros((len(a) + 1, len(b) + 1), np.int64)
        for i in range(len(a)):
            table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + weights[i]))
        out, i, j = [], len(a), len(b)
        while i and j:
            if table[i, j] == table[i - 1, j]:
                i -= 1
            elif table[i, j] == table[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out

    def align(self, one: list[tuple[int, str]], two: list[tuple[int, str]]) -> dict[int, int]:
        """Node of the first tree -> node of the second."""
        below, kinds = self.tree(one)
        below2, kinds2 = self.tree(two)
        if one == two:
            return {n: n for n in range(len(one))}
        found, open_pairs = {}, [(0, 0)]
        while open_pairs:
            a, b = open_pairs.pop()
            if one[a][1] != two[b][1]:
                continue
            found[a] = b
            ours, theirs = below[a], below2[b]
            if ours and theirs:
                open_pairs += [(ours[i], theirs[j]) for i, j in
                               self._pairs([kinds[c] for c in ours], [kinds2[c] for c in theirs])
                               if one[ours[i]][1] == two[theirs[j]][1]]
        return found


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def usable(page: Page) -> list[tuple[int, str]]:
    """(place in the page, text) of the blocks that no element's own name leaves out."""
    kept = [(i, b.text(page.dropped)) for i, b in enumerate(page.blocks) if not page.dropped[b.node]]
    return [(i, t) for i, t in kept if t]


def outline(page: Page) -> tuple[str, int, list[int], list[int], list[int]]:
    """The tree as lines of level and label, how many kinds of element it has, and node, place and hash of each block."""
    tree = page.tree()
    number = {node: i for i, (_, node) in enumerate(tree)}
    lines = [f"{level} {page.labels[node]}" for level, node in tree]
    blocks = usable(page)
    return ("\n".join(lines), len(set(lines)), [2 * number[page.blocks[i].node] + page.article[page.blocks[i].node] for i, _ in blocks],
            [i for i, _ in blocks], [hash64(t) for _, t in blocks])


def read_tree(lines: str) -> list[tuple[int, str]]:
    return [(int(level), label) for level, _, label in (line.partition(" ") for line in lines.split("\n"))]


def main_text(html: str, template: frozenset[int] = frozenset()) -> str:
    """The article's blocks, without those at the places that are template."""
    page = Page(html)
    blocks = usable(page)
    total = sum(len(t) for _, t in blocks)
    if template and sum(len(t) for i, t in blocks if i in template) <= COPY * total:
        blocks = [(i, t) for i, t in blocks if i not in template]
    if any(page.article[page.blocks[i].node] for i, _ in blocks):
        first = next((i for i, t in blocks if page.tags[page.blocks[i].node] == "h1"), -1)
        return "\n\n".join(t for i, t in blocks if page.article[page.blocks[i].node] or i == first)
    return "\n\n".join(t for _, t in region(page, blocks))


def region(page: Page, blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks of the smallest element with two thirds of the unlinked text, and the first heading."""
    count = len(page.tags)
    plain, linked, items = [0] * count, [0] * count, [0] * count
    for i, text in blocks:
        block = page.blocks[i]
        in_link = sum(len(t.strip()) for n, t, link in block.pieces if link and not page.dropped[n])
        linked[block.node] += in_link
        plain[block.node] += max(len(text) - in_link, 0)
        items[block.node] += 1
    for node in range(count - 1, 0, -1):
        for sums in (plain, linked, items):
            sums[page.parents[node]] += sums[node]
    menu, best = [False] * count, 0
    for node in range(1, count):
        menu[node] = menu[page.parents[node]] or (
            page.tags[node] in ("ul", "ol", "dl") and items[node] > 2 and linked[node] >= 4 * plain[node])
        if plain[0] and plain[node] >= REGION * plain[0] and page.parents[node] >= 0 and (
                page.parents[node] == best or best == 0 or plain[best] >= plain[node]):
            best = node  # page order: a later one that still holds as much lies inside
    inside = [node == best for node in range(count)]
    for node in range(1, count):
        inside[node] = inside[node] or inside[page.parents[node]]
    first = next((i for i, _ in blocks if page.tags[page.blocks[i].node] == "h1"), -1)
    return [(i, t) for i, t in blocks if i == first or inside[page.blocks[i].node] and not menu[page.blocks[i].node]]


def _keys() -> dict:
    return {"k1": F.xxhash64("url", "html"), "k2": F.xxhash64(F.lit(1), "html", "url")}


def template_marks(pages: DataFrame) -> DataFrame:
    """``k1, k2, places``: the blocks that are template, of pages (url, html) that have any."""
    source = pages.withColumn("host", host(F.col("url"))).where("host != ''").withColumns(_keys())

    def outlines(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for html in batch.column("html").to_pylist():
            page = Page(html)
            found.append((hash64(page.title), *outline(page)))
        columns = list(zip(*found)) or [()] * 6
        types = [pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 3]
        return pa.RecordBatch.from_arrays(
            [batch.column(n) for n in ("host", "k1", "k2")] + [pa.array(c, t) for c, t in zip(columns, types)],
            ["host", "k1", "k2", "title", "tree", "kinds", "nodes", "places", "hashes"])

    drawn = saved(map_slices(source.select("host", "k1", "k2", "html"), "html", outlines,
                             "host string, k1 bigint, k2 bigint, title bigint, tree string, kinds int, nodes array<bigint>, "
                             "places array<bigint>, hashes array<bigint>"), "outlines")
    pivots = saved(drawn.groupBy("host").agg(
        F.max(F.struct("kinds", (-F.length("tree")).alias("short"), "tree"))["tree"].alias("pivot"),
        F.min("title").alias("lo"), F.max("title").alias("hi")).where("lo != hi").select("host", "pivot"), "wrappers")
    size = pivots.agg(F.sum(F.length("pivot") + F.length("host") + 64)).first()[0] or 0
    paired = drawn.join(F.broadcast(pivots) if size <= BROADCAST_BYTES else pivots, "host")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, pivot, lines = Matcher(), None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                rows, out = [], []
                for row, (tree, other, nodes, places, hashes) in enumerate(zip(*[
                        piece.column(n).to_pylist() for n in ("tree", "pivot", "nodes", "places", "hashes")])):
                    if other != lines:
                        lines, pivot = other, read_tree(other)
                    slots = matcher.align(read_tree(tree), pivot)
                    seen: dict[int, int] = {}
                    for node, place, text in zip(nodes, places, hashes):
                        seen[node] = seen.get(node, -1) + 1  # an element's own blocks, in order
                        if node // 2 in slots:
                            rows.append(row)
                            out.append((slots[node // 2], seen[node], node % 2 == 1, place, text))
                columns = list(zip(*out)) or [()] * 5
                types = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(n).take(at) for n in ("host", "k1", "k2", "title")]
                    + [pa.array(c, t) for c, t in zip(columns, types)],
                    ["host", "k1", "k2", "title", "node", "part", "inside", "place", "text"])

    slots = saved(paired.mapInArrow(aligned, "host string, k1 bigint, k2 bigint, title bigint, node int, part int, inside boolean, "
                                             "place bigint, text bigint"), "slots")
    slot = ["host", "node", "part", "inside"]
    titles = slots.groupBy(*slot, "title").agg(F.min("text").alias("text"))
    texts = titles.groupBy(*slot, "text").agg(F.count(F.lit(1)).alias("n"))
    filled = texts.groupBy(*slot).agg(F.sum("n").alias("titles"), F.max(F.struct("n", "text")).alias("most"))

    def enough(least: int, share: float):
        return (F.col("most.n") >= least) & (F.col("most.n") >= F.col("titles") * F.lit(share))

    constant = saved(filled.where(F.when(F.col("inside"), enough(*INSIDE)).otherwise(enough(*OUTSIDE))).select(
        *slot, F.col("most.text").alias("text")), "template")
    size = constant.agg(F.sum(F.length("host") + 64)).first()[0] or 0
    marked = slots.join(F.broadcast(constant) if size <= BROADCAST_BYTES else constant, [*slot, "text"])
    return saved(marked.groupBy("k1", "k2").agg(F.collect_set("place").alias("places")), "template-marks")


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: ``page_id, url, text, n_chars, n_template`` (blocks that went as template or as copies would have)."""
    source = pick(pages, page_id=page_id, url=url, html=html)
    source = source.withColumn("html", F.coalesce(F.col("html").cast("string"), F.lit("")))
    marks = template_marks(source.select("url", "html"))
    size = marks.agg(F.sum(F.size("places") * 8 + 48)).first()[0] or 0
    keyed = source.withColumns(_keys())
    if size:
        keyed = keyed.join(F.broadcast(marks) if size <= BROADCAST_BYTES else marks, ["k1", "k2"], "left")
    else:
        keyed = keyed.withColumn("places", F.lit(None).cast("array<bigint>"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page, frozenset(places or ())) for page, places in
                 zip(batch.column("html").to_pylist(), batch.column("places").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p or ()) for p in batch.column("places").to_pylist()], pa.int64())],
            ["page_id", "url", "text", "n_chars", "n_template"])

    kind = source.schema["page_id"].dataType.simpleString()
    return map_slices(keyed.select("page_id", "url", "html", "places"), "html", work,
                      f"page_id {kind}, url string, text string, n_chars bigint, n_template bigint")
