"""Cases of the second verdict."""

import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sondage.llm import decontaminate, huffman, language, quality, token_counts, toxicity, urlrules
from sondage.llm.queries import CASES
from sondage.llm.registry import table, tokenizer_path
from sondage.llm.tokens import Encoder
from sondage.session import checkpoint_dir, shared_path
from tools.compare import compare, connect


def plain_counts(offsets, parts, rule):
    """Tokens by rule and tokens overlapping of the parts (first, last), one token after the other."""
    own, over = [0] * len(parts), [0] * len(parts)
    for start, stop in offsets:
        shares = [min(stop, last) - max(start, first) for first, last in parts]
        for k, share in enumerate(shares):
            over[k] += share > 0
        before = max(k for k, (first, _) in enumerate(parts) if first <= start)
        own[before if rule == "first" or max(shares) <= 0 else shares.index(max(shares))] += 1
    return own, over


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_of_sections_and_fields_one_by_one(spark, rule):
    library = Encoder(tokenizer_path()).tokenizer
    rnd = random.Random(3)
    texts = ["", None, "one", "extraordinarily uncharacteristic", "ça été Ünïverselles " * 30] + [
        "".join(rnd.choice("abcdefgh éß中,. ") for _ in range(rnd.randrange(200))) for _ in range(30)]
    docs = spark.createDataFrame([(k, f"src{k % 3}net", t) for k, t in enumerate(texts)], "doc_id bigint, source string, text string")
    crossed = 0
    rows = token_counts.count_by_section(docs, tokenizer_path(), size=7, rule=rule).orderBy("doc_id", "section").collect()
    for k, text in enumerate(texts):
        mine = [r for r in rows if r["doc_id"] == k]
        size = len(text or "")
        parts = [(a, min(a + 7, size)) for a in range(0, max(size, 1), 7)]
        own, over = plain_counts(library.encode(text or "", add_special_tokens=False).offsets, parts, rule)
        assert [(r["start"], r["stop"]) for r in mine] == parts
        assert [r["n_tokens"] for r in mine] == own and [r["overlapping"] for r in mine] == over
        crossed += own != over
    assert crossed > 20
    rows = token_counts.count_by_field(docs, tokenizer_path(), ["source", "text"], separator="", rule=rule).collect()
    for k, text in enumerate(texts):
        mine = [r for r in rows if r["doc_id"] == k]
        line = f"src{k % 3}net" + (text or "")
        own, over = plain_counts(library.encode(line, add_special_tokens=False).offsets, [(0, 7), (7, len(line))], rule)
        assert [r["n_tokens"] for r in mine] == own and [r["overlapping"] for r in mine] == over


def test_the_query_has_tokens_over_section_ends(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = CASES["op3_token_counts"](spark, sf_dir)
    assert rows.where("overlapping != n_tokens").count() > 0
    library = Encoder(tokenizer_path()).tokenizer
    docs = table(spark, sf_dir, "documents").select("text").collect()
    total = sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs)
    assert rows.agg(F.sum("n_tokens")).first()[0] == total


def test_more_ids_than_sixteen_bits():
    counts = np.ones(70_000, np.int64)
    counts[:100] = 1_000_000
    lengths = huffman.code_lengths(counts, huffman.longest_for(len(counts)))
    assert lengths.max() <= 19 and (2.0 ** -lengths).sum() <= 1
    ids = np.random.default_rng(2).permutation(70_000)
    codec = huffman.Codec(lengths)
    payload, blocks, lanes = codec.encode(ids)
    assert (codec.decode(payload, blocks, lanes, len(ids)) == ids).all()
    for entry in (0, 1, 15, 16, 100, len(lanes) - 1):
        assert (codec.decode(payload, blocks, lanes, len(ids), entry) == ids[entry * huffman.LANE:]).all()


def test_a_span_is_read_from_its_lane(spark, monkeypatch):
    monkeypatch.setattr(huffman, "CHUNK", 3000)
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("doc_id < 60").repartition(3)
    path = huffman.write_store(docs, tokenizer_path(), shared_path(spark, "store"))
    whole = [i for r in sorted(huffman.read_store(spark, path).collect(), key=lambda r: r["start"]) for i in r["ids"]]
    for start, stop in ((0, 1), (0, len(whole)), (255, 257), (1000, 9000), (len(whole) - 3, len(whole) + 5), (5, 5)):
        rows = sorted(huffman.read_span(spark, path, start, stop).collect(), key=lambda r: r["start"])
        assert [i for r in rows for i in r["ids"]] == whole[start:stop]


def plain_hits(words, items, window):
    """Words inside occurrences of windows, and the items, by trying every place."""
    hit, found = set(), set()
    for item, held in items:
        size = min(window, len(held))
        parts = {tuple(held[i:i + size]) for i in range(len(held) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i:i + size]) in parts:
                hit.update(range(i, i + size))
                found.add(item)
    return hit, sorted(found)


@pytest.mark.parametrize("window,signs", [(13, None), (4, None), (5, 3), (1, None), (2, 4)])
def test_runs_are_what_every_window_covers(monkeypatch, window, signs):
    if signs:  # more words than signs: two characters a word
        monkeypatch.setattr(decontaminate.Items, "SIGNS", signs)
    rnd = random.Random(window)
    for _ in range(60):
        items = [(str(k), [rnd.choice("abc") for _ in range(rnd.randrange(30))]) for k in range(5)]
        known = decontaminate.Items([(k, " ".join(w)) for k, w in items], window)
        for _ in range(10):
            words = [rnd.choice("abcx") if rnd.random() < 0.2 else rnd.choice("abc") for _ in range(rnd.randrange(40))]
            if rnd.random() < 0.7:
                held = rnd.choice(items)[1]
                words[3:3] = held[rnd.randrange(5):]
            runs = known.runs(words) if words and not known.empty else []
            hit = {p for a, b, _ in runs for p in range(a, b)}
            assert (hit, sorted({known.names[i] for _, _, i in runs})) == plain_hits(words, items, window)


def test_sixteen_megabytes_of_items_are_one_automaton():
    import resource
    rnd = np.random.default_rng(5)
    words = np.array([f"word{k}" for k in range(50_000)])
    items = [(str(k), " ".join(words[rnd.integers(0, len(words), 200)])) for k in range(2000)]  # 3.7 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    known = decontaminate.Items(items, 13)
    assert known.machine.get_stats()["nodes_count"] <= 400_001
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 120_000  # KB, so below 500 MB for 16 MB
    text = items[7][1].split()[20:60]
    assert known.runs(["other", *text, "other"]) == [(1, 41, 7)]


def test_stop_words_are_asked_for_in_known_letters_only(spark):
    russian = " ".join(f"слово{k} и дело" for k in range(40))
    polish = " ".join(f"książka{k} będzie świeża" for k in range(40))
    nothing = " ".join(f"alpha{k}x" for k in range(120))
    texts = [russian, polish, nothing, nothing + " the café", nothing + " the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert kept == {0: True, 1: True, 2: False, 3: True, 4: True}
    assert quality.keep_good(docs).count() == 4


def test_host_path_and_rule_of_every_page(spark):
    sf_dir = "/root/testdata/sf0.01"
    sql = """
        WITH p AS (SELECT page_id, translate(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
          r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
              ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
        SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict FROM p LEFT JOIN r
          ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1"""
    rows = CASES["op10_url_rules"](spark, sf_dir)
    ruled = rows.withColumn("verdict", F.when(F.col("rule").isNotNull(), F.col("verdict"))).drop("mined")
    assert compare(ruled, connect(sf_dir), sql) is None
    assert rows.where("verdict not in ('allow', 'block') or verdict is null").count() == 0


def test_rules_that_repeat_a_shorter_one_go(spark):
    rows = [(["a"], "block", 0.9), (["a", "b"], "block", 0.9), (["a", "c"], "block", 0.95), (["a", "b", "c"], "block", 0.93),
            (["a", "d"], "allow", 0.8), (["b"], "allow", 0.99)]
    rules = spark.createDataFrame([(t, v, c, 0.1, t[0]) for t, v, c in rows],
                                  "tokens array<string>, verdict string, confidence double, support double, key string")
    assert sorted("".join(r["tokens"]) for r in urlrules.pruned(rules).collect()) == ["a", "ac", "ad", "b"]


def test_odd_urls(spark):
    urls = ["https://a.org/x", "https://a.org/x", None, "x" * 100_000, "https://" + "b." * 5000 + "net/" + "p/" * 5000 + "?a=1&b=2"]
    pages = spark.createDataFrame([(1, u, "h", 2) for u in urls], "page_id bigint, url string, host string, tokens int")
    known = spark.createDataFrame([(f"https://a.net/{k}", "block") for k in range(20)] + [(None, "allow"), ("no", None)],
                                  "url string, label string")
    rows = urlrules.judge(pages, known).collect()
    assert len(rows) == 5 and {r["page_id"] for r in rows} == {1} and all(r["verdict"] in ("allow", "block") for r in rows)


def test_planted_labels_become_rules(spark):
    urls = [f"http://h{k % 9}.example.net/{'ads' if k % 3 == 0 else 'news'}/{k}" for k in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    known = spark.createDataFrame([(u, "block" if "/ads/" in u else "allow") for u in urls[:200]], "url string, label string")
    rows = {r["page_id"]: r for r in urlrules.judge(pages, known, rules=[]).collect()}
    assert all(rows[k]["verdict"] == ("block" if "/ads/" in u else "allow") for k, u in enumerate(urls))
    assert all(list(rows[k]["mined"]) == ["dir:ads" if "/ads/" in u else "dir:news"] for k, u in enumerate(urls))


def test_packed_pieces_are_the_librarys(spark):
    sf_dir = "/root/testdata/sf0.001"
    library = Encoder(tokenizer_path()).tokenizer
    want = set()
    for r in table(spark, sf_dir, "documents").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want |= {(r["doc_id"], k, a, len(ids[a:a + 4096]), zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes()))
                 for k, a in enumerate(range(0, len(ids), 4096))}
    rows = CASES["op2_packing"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)


def test_the_pipeline_leaves_only_its_last_tables(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    left = {n.rpartition("-")[0] for n in set(os.listdir(folder)) - before}
    assert "decontamination" in left and not left & {"quality_rules", "language_id", "near_duplicates", "shingle-sets", "links", "pairs"}


def plain_bytes(text, digits):
    """Bytes with ASCII letters in lower case and every other ASCII sign (but digits, if kept) as a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or digits and 48 <= b <= 57 else 32
                 for b in (text or "").encode())


def test_language_scores_gram_by_gram(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = language.train(docs)
    texts = [r["text"] for r in docs.limit(25).collect()] + [None, "", "ab", "  ", "ça va très bien", "42 + 17", "x" * 300]
    langs, scores, _ = model.predict(pa.array(texts, pa.string()))
    for text, lang, score in zip(texts, langs, scores):
        low, counts = plain_bytes(text, False), {}
        for a, b, c in zip(low, low[1:], low[2:]):
            if not (a == 32 and b == 32):
                h = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)
                h = ((h ^ h >> 16) * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - language.BITS)
                counts[h] = counts.get(h, 0) + 1
        if not any(ch.isalpha() for ch in text or ""):
            assert (lang, score) == ("und", 0.0)
            continue
        weights = {h: math.log1p(n) * float(model.idf[h]) for h, n in counts.items()}
        length = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        cosines = [sum(w * float(centre[h]) for h, w in weights.items()) / length for centre in model.centres]
        assert score == pytest.approx(min(max(max(cosines), 0.0), 1.0), abs=1e-4)
        assert cosines[model.names.index(lang)] <= max(cosines) + 1e-6
        assert max(c for c, name in zip(cosines, model.names) if name == lang) == pytest.approx(max(cosines), abs=1e-4)


def test_toxicity_scores_gram_by_gram(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs.join(table(spark, sf_dir, "labels"), "doc_id"), label="toxic")
    assert np.count_nonzero(model.weights) > 100
    texts = [r["text"] for r in docs.limit(25).collect()] + [None, "", "abc", " -- ", "Ça va, toi?", "a  b  c  d"]
    for text, score in zip(texts, model.scores(pa.array(texts, pa.string()))):
        low = re.sub(rb" +", b" ", plain_bytes(text, True))
        found = set()
        for n in toxicity.GRAMS:
            for i in range(len(low) - n + 1):
                h = n
                for b in low[i:i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
                found.add(((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - toxicity.BITS))
        total = sum(model.weights[h] for h in found) + model.bias
        assert score == pytest.approx(1 / (1 + math.exp(-min(max(total, -40.0), 40.0))), abs=1e-9)
