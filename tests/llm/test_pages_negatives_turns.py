"""Main text, hard negatives and conversation repair beside plain versions, and their odd inputs."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import hardneg, turns, wrapper
from sondage.llm.dom import Page
from sondage.llm.queries import CASES
from sondage.llm.registry import table

# conversation repair


def plain_repair(rows):
    """Every script, state by state, for rows (turn, role, text) in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    counts, seen, symbols = {"b": 0, "d": 0, "t": 0}, set(), []
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        symbols.append((fault, role, text))
        if fault:
            counts[fault] += 1
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    put = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                new, role = put[state]
                option = (cost + 2, audit + "I", [*lines, role + ":"])
                if new not in best or option[:2] < best[new][:2]:
                    best[new] = option
        return best

    best = {0: (0, "", [])}
    for fault, role, text in symbols:
        found, late = {}, int(fault == "t")

        def keep(state, option):
            if state not in found or option[:2] < found[state][:2]:
                found[state] = option

        for state, (cost, audit, lines) in inserted(best).items():
            keep(state, (cost + 3, audit + "D", lines))
            if fault not in ("b", "d"):
                keep(put[state][0], (cost + 2 + late, audit + "R", [*lines, f"{put[state][1]}:{text}"]))
                if role[:1] in after[state]:
                    keep(after[state][role[:1]], (cost + late, audit + "K", [*lines, f"{role}:{text}"]))
        best = found
    best = inserted(best)
    cost, audit, lines = min((best[s] for s in (0, 3) if s in best), key=lambda b: b[:2])
    known = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def drawn_rows(rnd, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "and so", " \n", "", None, "Why?", "Ünï", "a. \t"]
    return [(rnd.choice([None, *range(max(n, 2))]), rnd.choice(roles), rnd.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("piece", [7, 4096])
def test_repair_equals_every_script(spark, monkeypatch, piece):
    monkeypatch.setattr(turns, "PIECE", piece)
    rnd = random.Random(piece)
    conversations = {c: drawn_rows(rnd, rnd.randrange(1, 9)) for c in [None, *range(120)]}
    conversations[500] = drawn_rows(rnd, 400)  # spread over several parts, pieces and blocks
    conversations[501] = [(1, "user", "same.")] * 60
    rows = [(c, t, r, x, "extra", 1) for c, held in conversations.items() for t, r, x in held]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, conv string, part int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["conv_id"]: tuple(r)[1:] for r in turns.repair(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {c: plain_repair(held) for c, held in conversations.items()}


def test_block_tables_equal_single_steps():
    t = turns.tables()
    rnd = random.Random(3)
    for _ in range(300):
        vector, symbols = rnd.randrange(len(t.vectors)), [rnd.randrange(turns.SYMBOLS) for _ in range(turns.LENGTH)]
        code = sum(s * turns.SYMBOLS ** k for k, s in enumerate(reversed(symbols)))
        costs = t.vectors[vector]
        for symbol in reversed(symbols):
            costs = turns._before(costs, symbol)
        added = t.total[vector][code]
        assert tuple(c + added for c in t.vectors[t.block[vector][code]]) == costs
    assert turns.trace(b"") == ("", 0)


def test_repair_of_nothing(spark):
    frame = spark.createDataFrame([], "conv_id string, turn bigint, role string, text string")
    assert turns.repair(frame).count() == 0


def test_repair_query_returns_every_conversation(spark, tmp_path):
    import zlib
    gone = next(c for c in range(10 ** 6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi."), (None, None, None, None)],
                          "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r["conv_id"]: tuple(r)[1:] for r in CASES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    assert rows[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert rows[None][1] == 1 and rows[None][6] == "D"


# hard negatives


def plain_negatives(rows, anchor, positives=5, negatives=3):
    live = []
    for place, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            live.append((place, i, [math.floor(256 * x) for x in v], label))
    out = []
    for place, i, v, label in live:
        if i is None or not anchor(i):
            continue
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, p, j, other) for p, j, w, other in live
                         if p != place and len(w) == len(v)))
        for minus, _, _, _, j, other in [s for s in scores if s[5] == label][:positives]:
            held = [s for s in scores if s[5] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus][:negatives]
            out += [(i, j, rank + 1, s[4], -minus, -s[0]) for rank, s in enumerate(held)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,group,size", [(4096, 16384, 1.0), (7, 2, 1.0), (7, 2, 30000.0), (5, 3, 1e6)])
def test_negatives_equal_every_score(spark, block, group, size):
    rnd = np.random.default_rng(block)
    rows = [(k, (rnd.normal(size=6) * size).astype(np.float32).tolist(), int(k % 3)) for k in range(40)]
    rows += [(41, [1.0] * 6, None), (42, None, 1), (43, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (44, [float("nan")] * 6, 1),
             (45, [float("inf")] * 6, 1), (None, [0.5] * 6, 0), (None, [0.5] * 6, 2), (10, [0.7] * 6, 1), (10, [0.7] * 6, 2),
             (60, [0.5, 0.25], 1), (61, [0.5, 0.25], 1), (62, [0.25, 0.25], 2), (70, [], 1), (71, [], 1), (72, [], 2)]
    frame = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows],
                                  "vec_id bigint, embedding array<float>, label int, score string, `row` int").repartition(3)
    got = hardneg.mine(frame, lambda i: i % 10 == 0, block=block, group=group)
    assert sorted(map(tuple, got.collect()), key=str) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_scores_beyond_64_bits_stay_at_the_end_of_their_range(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 2.0], 1), (2, [5e29, 1.0], 2), (3, [1.0, 1.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = hardneg.mine(frame, lambda i: i == 0).collect()
    assert all(r["positive_score"] == r["negative_score"] == hardneg.MOST for r in got) or not got


def test_packed_products_are_exact():
    rnd = np.random.default_rng(1)
    for reach in (1, 300, 1 << 20, 1 << 40):
        vectors = rnd.integers(-reach, reach + 1, (9, 5))
        for anchor in rnd.integers(-reach, reach + 1, (4, 5)).tolist():
            scores = hardneg.Packed(vectors, reach).scores(anchor)
            assert [int(s) for s in scores] == [sum(int(a) * int(c) for a, c in zip(anchor, v)) for v in vectors]


def test_negatives_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hardneg.mine(frame, lambda i: i % 50 == 0).count() == 0


# main text


def plain_score(a, b):
    """Simple tree matching of (label, children) by its recurrence."""
    if a[0] != b[0]:
        return 0
    table = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + plain_score(x, y))
    return table[-1][-1] + 1


def drawn_tree(rnd, depth):
    return rnd.choice("abc"), [drawn_tree(rnd, depth - 1) for _ in range(rnd.randrange(5) if depth else 0)]


def listed(tree, level=0):
    return [(level, tree[0])] + [n for child in tree[1] for n in listed(child, level + 1)]


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_matching_is_the_largest(monkeypatch, cells):
    monkeypatch.setattr(wrapper, "CELLS", cells)
    rnd = random.Random(cells)
    for _ in range(300):
        one, two = drawn_tree(rnd, 3), drawn_tree(rnd, 3)
        a, b = listed(one), listed(two)
        pairs = wrapper.Matcher().align(a, b)
        assert len(pairs) == plain_score(one, two)
        assert all(a[x] == b[y] for x, y in pairs.items())
        assert [pairs[x] for x in sorted(pairs)] == sorted(set(pairs.values()))


PAGE = ("<html><head><title>{t}</title></head><body><div class=top-menu><a href=/>Home</a></div><div id=c><h2>{t}</h2>"
        "<p>{x}<p>And {x} too<div>Read our terms before you write</div></div><div>All rights kept by the house of {h}</div></body></html>")


def test_template_is_what_a_host_repeats(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(t=f"Title {i}", x=f"Words {i} that <b>vary</b>", h=i % 2)) for i in range(12)]
    rows += [(100 + i, f"http://copies.org/{i}", PAGE.format(t=f"Copy {i}", x="One text for all", h="copies")) for i in range(9)]
    rows += [(200, "http://alone.org/", PAGE.format(t="Alone", x="Nothing to compare", h="none"))]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in wrapper.extract(frame).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\n\nWords {i} that vary\n\nAnd Words {i} that vary too"
    assert all("One text for all" in got[100 + i] and "And One text" in got[100 + i] for i in range(9))
    assert "Nothing to compare" in got[200]


ARTICLE = ("<body><header>Site</header><nav><ul><li><a>Menu</a></ul></nav><main><article><header><h1>Head &amp; more</h1></header>"
           "<p>One&nbsp;two<br>three <!-- no --><a href='x>y'>link</a>s<p class='newsletter-box'>Sign up<p>Four<script>'</p>'</script>!"
           "<form><p>Your mail</form><aside>Beside</aside><ul><li>a<li>b</ul><table><tr><td>1<td>2</table>"
           "<div class=comments><article><p>First!</article></div><article><p>A reader says</article></article>"
           "<div>After</div></main><div class='ad box'>Buy</div><footer>&copy; us</footer>")


def test_blocks_of_an_article():
    assert wrapper.main_text(ARTICLE).split("\n\n") == ["Head & more", "One two three links", "Four!", "a", "b", "1", "2"]


@pytest.mark.parametrize("html,text", [
    ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a", "a"), ("a<", "a<"), ("<p>a</p", "a"), ("<p title='x>y", "y"),
    ("<article><p>a &lt; b &am &amp</p></article>", "a < b &am &"), ("<p>x<!-- y", "x"), ("<script>var a = '<p>';", ""),
    ("</p></div>x", "x"), ("<b><p>one</b> two</p>", "one two"), ("a < b > c", "a < b > c"),
    ("<form><article>kept</article></form>", "kept"), ("<article>1<p hidden>2<p style='display: none'>3<p>4</article>", "1\n\n4"),
    ("<table><tr><td>a<table><tr><td>b</table>c</table>", "a\n\nb\n\nc"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
])
def test_odd_markup(html, text):
    assert wrapper.main_text(html) == text


def test_odd_pages(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20000 + "</article>"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "http://a.org/", None), (1, "http://a.org/", None), (2, None, "<p>x</p>"), (None, "no host", "<p>y</p>"), (3, "http://a.org/1", long),
            (4, "http://a.org/2", long + "<p>z"), (5, "http://a.org/3", deep), (5, "http://a.org/3", deep)]
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, k1 int")
    got = sorted((str(r["page_id"]), r["url"] or "", r["text"], r["n_chars"]) for r in wrapper.extract(frame).collect())
    words = "\n\n".join(["word & word"] * 20000)
    texts = ["", "", "x", "y", words, words, "deep", "deep"]
    assert got == sorted((str(i), u or "", t, len(t)) for (i, u, _), t in zip(rows, texts))
    assert wrapper.extract(frame.limit(0)).count() == 0


def test_pages_hold_their_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in table(spark, sf_dir, "documents").collect()}
    known = 0
    for r in CASES["op11_main_text"](spark, sf_dir).withColumn("doc", F.regexp_extract("url", r"://[^/]*/\w+/(\d+)", 1).cast("long")).collect():
        if r["doc"] in docs:
            known += 1
            head, _, body = r["text"].partition("\n\n")
            assert " ".join(body.split()) == docs[r["doc"]] and r["n_chars"] == len(r["text"])
    assert known > 20


def test_trees_are_cut_at_what_is_left_out():
    page = Page("<body><nav><ul><li>x</ul></nav><p>y")
    assert [page.labels[n] for _, n in page.tree()] == ["#page", "body", "nav", "p"]
