"""The corpus operators beside their SQL, a plain version, or an exact round trip; and the odd inputs."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sondage.llm import (components, decontaminate, fixity, huffman, language, packing, partenum, quality, token_counts,
                         toxicity, urlrules)
from sondage.llm.queries import CASES, ORACLES
from sondage.llm.registry import tokenizer_path
from sondage.llm.tokens import Encoder
from sondage.session import shared_path
from tools.compare import compare, connect

LONG = "word and more of it " * 20000
ODD = [(1, "The quick fox."), (1, "The quick fox."), (2, None), (3, ""), (4, " \n\t "), (None, "the of and"), (5, LONG),
       (6, "ça été Ünï ***"), (7, "<|endoftext|> don't"), (8, "12 34 &&&"), (None, None)]
EXTRA = "doc_id bigint, text string, counts string, row string, cls bigint, `a.b` string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", 9, "z", "en") for i, t in ODD], EXTRA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the quick fox"), (2, None), (None, "the"), (1, "the quick fox"), (3, "...")],
                                 "item_id bigint, text string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert compare(CASES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


def test_encoder_equals_the_library():
    encoder = Encoder(tokenizer_path(), spans=True)
    rnd = random.Random(5)
    texts = [t for _, t in ODD] + ["İ ΣΑΣ A\u030a \u2126 ½x ９a", "x's'll '' 'S *'s a<|ENDOFTEXT|>"] + [
        "".join(rnd.choice("aB1 '*é\u0301<|>ß\n中") for _ in range(60)) for _ in range(200)]
    ids, bounds, starts, stops = encoder(pa.array(texts, pa.string()))
    quick_ids, quick_bounds = Encoder(tokenizer_path())(pa.array(texts, pa.string()))
    assert (ids == quick_ids).all() and (bounds == quick_bounds).all()
    for i, text in enumerate(texts):
        want = encoder.tokenizer.encode(text or "", add_special_tokens=False)
        part = slice(bounds[i], bounds[i + 1])
        assert ids[part].tolist() == want.ids
        assert list(zip(starts[part].tolist(), stops[part].tolist())) == want.offsets


def test_decontamination_spans_and_blocks(spark, odd, benchmark, empty):
    found = {(r["doc_id"], r["n_words"]): r for r in decontaminate.find_items(odd, benchmark).collect()}
    hit = found[1, 3]
    assert hit["items"] == ["1"] and (hit["spans"][0]["start_char"], hit["spans"][0]["stop_char"]) == (0, 13)
    assert found[2, 0]["items"] == [] and found[5, 100000]["items"] == []
    many = decontaminate.find_items(odd, benchmark, block_bytes=14)
    key = lambda r: str((r["doc_id"], r["n_words"], r["spans"], r["items"]))
    assert sorted(map(key, many.collect())) == sorted(map(key, decontaminate.find_items(odd, benchmark).collect()))
    kept = decontaminate.drop_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2
    assert decontaminate.find_items(empty, benchmark).count() == 0
    assert decontaminate.find_items(odd, benchmark.limit(0)).where("size(items) > 0").count() == 0


def plain_best_fit(sizes, capacity):
    bins = []
    for size in sorted(sizes, reverse=True):
        fitting = [b for b in bins if sum(b) + size <= capacity]
        if fitting:
            max(fitting, key=sum).append(size)
        else:
            bins.append([size])
    return len(bins)


def test_best_fit_is_best_fit():
    rnd = random.Random(2)
    for _ in range(30):
        sizes = np.array([rnd.randint(1, 64) for _ in range(rnd.randint(0, 80))], np.int64)
        bins, offsets, fills = packing.best_fit(sizes, 64)
        assert len(fills) == plain_best_fit(sizes.tolist(), 64)
        for b in range(len(fills)):
            inside = sorted((o, s) for k, o, s in zip(bins, offsets, sizes) if k == b)
            assert [o for o, _ in inside] == np.cumsum([0, *[s for _, s in inside]])[:-1].tolist()


@pytest.mark.parametrize("group_items", [3, 20000])
def test_packing_is_gapless_and_whole(spark, odd, empty, group_items):
    rows = packing.pack(odd.repartition(4), tokenizer_path(), capacity=16, group_items=group_items).collect()
    library = Encoder(tokenizer_path()).tokenizer
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    assert sum(r["length"] for r in rows) == total
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_bin.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 16
    assert len(by_bin) <= -(-total // 16) + 2
    assert packing.pack(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(odd, empty, rule):
    rows = token_counts.count_by_field(odd, tokenizer_path(), ["lang", "text", "a.b"], separator="", rule=rule).collect()
    library = Encoder(tokenizer_path()).tokenizer
    total = sum(len(library.encode("en" + (t or "") + "z", add_special_tokens=False).ids) for _, t in ODD)
    assert len(rows) == 3 * len(ODD) and sum(r["n_tokens"] for r in rows) == total
    assert all(r["overlapping"] >= 0 for r in rows) and sum(r["overlapping"] for r in rows) >= total
    assert token_counts.count_by_field(empty, tokenizer_path(), ["text"]).count() == 0


def test_allocation_rules():
    first, last = np.array([0, 4]), np.array([4, 9])
    starts, stops = np.array([0, 2, 7]), np.array([2, 7, 9])  # the second token has two characters here, three there
    assert token_counts.attributed(starts, stops, first, last, "first")[0].tolist() == [2, 1]
    assert token_counts.attributed(starts, stops, first, last, "most")[0].tolist() == [1, 2]
    assert token_counts.attributed(starts, stops, first, last, "first")[1].tolist() == [2, 2]


def test_quality_on_odd_rows_and_filters(odd, empty):
    rows = {(r["doc_id"], r["n_words"]): r for r in quality.judge(odd).collect()}
    assert rows[2, 0]["n_words"] == rows[3, 0]["n_words"] == rows[4, 0]["n_words"] == 0
    assert rows[5, 100000]["n_repeat_words"] == 100000 and rows[5, 100000]["base_failed"]
    assert quality.judge(empty).count() == 0
    words = [f"alpha{i}" for i in range(60)] + ["the"]
    good = odd.limit(1).withColumn("text", F.lit(" ".join(words)))
    assert quality.keep_good(odd.unionByName(good)).select("text").collect() == [(" ".join(words),)]
    assert quality.keep_good(odd).columns == odd.columns


def test_huffman_is_optimal_within_its_limit_and_round_trips():
    rnd = np.random.default_rng(4)
    counts = np.zeros(500, np.int64)
    counts[rnd.choice(500, 300, False)] = (1 / rnd.random(300) ** 3).astype(np.int64) + 1
    lengths = huffman.code_lengths(counts)
    used = lengths[counts > 0]
    assert used.max() <= huffman.LONGEST and (2.0 ** -used).sum() == 1 and (lengths[counts == 0] == 0).all()
    for n in (0, 1, 255, 256, 4095, 4096, 4097, 20000):
        ids = rnd.choice(np.flatnonzero(counts), n)
        codec = huffman.Codec(lengths)
        payload, blocks, lanes = codec.encode(ids)
        assert (codec.decode(payload, blocks, lanes, n) == ids).all()
    tight = huffman.code_lengths(2 ** np.arange(20, dtype=np.int64), 6)
    assert tight.max() == 6 and (2.0 ** -tight).sum() <= 1


def test_token_store_round_trip(spark, odd, empty):
    path = huffman.write_store(odd, tokenizer_path(), shared_path(spark, "store"))
    library = Encoder(tokenizer_path()).tokenizer
    want = sorted([library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in ODD])
    rows = huffman.read_store(spark, path).collect()
    assert sorted(list(r["ids"]) for r in rows) == want
    start = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] or -1 for r in sorted(rows, key=lambda r: r["start"])] == sorted(i or -1 for i, _ in ODD)
    crcs = sorted(r["ids_crc32"] for r in huffman.digest(spark, path).collect())
    assert crcs == sorted(zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in want)
    assert huffman.digest(spark, huffman.write_store(empty, tokenizer_path(), shared_path(spark, "store"))).count() == 0


def near_texts():
    rnd = random.Random(7)
    texts = []
    for size in (1, 2, 3, 8, 30, 120, 400):
        base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            words = list(base)
            for _ in range(edits):
                words[rnd.randrange(size)] = f"e{rnd.randrange(5000)}"
            texts.append(" ".join(words))
    return texts + ["", None, "  "]


@pytest.mark.parametrize("num,den,words,block,few", [(9, 10, 3, 4096, 16), (8, 10, 5, 3, 16), (8, 10, 5, 3, 0)])
def test_jaccard_join_against_all_pairs(spark, monkeypatch, num, den, words, block, few):
    monkeypatch.setattr(partenum, "BLOCK", block)
    monkeypatch.setattr(partenum, "FEW", few)
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", (t or "").lower())
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    name = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = name[a], name[b]
                name = [min(x, y) if n in (x, y) else n for n in name]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.near_duplicates(
        docs, numerator=num, denominator=den, words=words).collect()}
    assert got == {i: (len(s), name[i]) for i, s in enumerate(sets)}


def test_jaccard_join_on_odd_rows(odd, empty):
    assert partenum.near_duplicates(odd).count() == len(ODD)
    assert partenum.near_duplicates(empty).count() == 0
    assert partenum.keep_one(odd).columns == odd.columns


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}


def test_language_accuracy_and_odd_rows(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where("doc_id % 5 != 0"))
    held = language.identify(docs, model).where("doc_id % 5 = 0").join(docs.select("doc_id", "lang"), "doc_id")
    right, rejected, n = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int")),
                                  F.count(F.lit(1))).first()
    assert right > 0.97 and rejected <= 0.01 * n
    rows = {r["doc_id"]: r for r in language.identify(odd.where("doc_id is not null"), model).collect()}
    assert [rows[i]["lang_pred"] for i in (2, 3, 4, 8)] == ["und"] * 4 and rows[6]["lang_pred"] != "und"
    assert language.keep_known(odd, model).columns == odd.columns
    foreign = odd.limit(1).withColumn("text", F.lit("это совсем другой язык с другими буквами и словами " * 20))
    assert language.keep_known(foreign, model).count() == 0
    assert language.identify(odd, language.train(empty)).where("lang_pred = 'und'").count() == len(ODD)


def test_toxicity_accuracy_and_odd_rows(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    model = toxicity.train(rows.where("doc_id % 3 != 1"), label="toxic")
    held = toxicity.score(docs, model).join(rows.where("doc_id % 3 = 1").select("doc_id", "toxic"), "doc_id").collect()
    toxic = [r["score"] >= 0.7 for r in held if r["toxic"]]
    clean = [r["score"] >= 0.7 for r in held if not r["toxic"]]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) == 0
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == len(ODD)
    none = toxicity.train(empty.withColumn("toxic", F.lit(1)), label="toxic")
    assert toxicity.score(odd, none).where("score > 0.01").count() == 0


def test_fixity_finds_every_fault(spark):
    n = 5000
    rows = spark.range(n).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("h"), "id").alias("html"))
    copy = rows.where("page_id not in (0, 70)").withColumn("html", F.when(F.col("page_id") == 4999, "?").otherwise(F.col("html")))
    copy = copy.unionByName(rows.where("page_id = 5").withColumn("page_id", F.lit(-5).cast("long")))
    found = sorted((r["record_id"], r["kind"]) for r in fixity.audit(rows, copy).collect())
    assert found == [(-5, "extra"), (0, "missing"), (70, "missing"), (4999, "changed")]
    assert fixity.audit(rows, rows).count() == 0 and fixity.audit(rows.limit(0), rows.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, None, None), (None, "u", "h"), (1, "u", "h"), (1, "u", "h")],
                                  "page_id bigint, url string, html string")
    assert fixity.audit(twice, twice).count() == 0
    assert [r["kind"] for r in fixity.audit(twice, twice.limit(3)).collect()] == ["missing"]


def test_url_rules_against_counting(spark):
    urls = [f"https://{h}.example.{t}/{d}/{i}" for i, (h, t, d) in enumerate(
        (h, t, d) for h in ("a", "b") for t in ("org", "com", "net") for d in ("en", "fr", "de", "es") for _ in range(4))]
    pages = spark.createDataFrame(list(enumerate([*urls, None, "", "no scheme", "HTTP://A.Example.ORG", "x://org/"])),
                                  "page_id bigint, url string")
    rows = {r["page_id"]: r for r in urlrules.judge(pages, support=0.05).collect()}
    assert len(rows) == len(urls) + 5
    assert [rows[len(urls) + k]["host"] for k in range(5)] == ["", "", "", "a.example.org", "org"]
    assert rows[len(urls) + 4]["rule"] == "org/" and rows[len(urls)]["verdict"] == "allow"
    tokens = {r["page_id"]: set(r["tokens"]) for r in pages.withColumns(
        {"host": urlrules.host(F.col("url")), "path": urlrules.path(F.col("url"))}).withColumn("tokens", urlrules.tokens()).collect()}
    known = [(tokens[i], r["verdict"]) for i, r in rows.items() if r["rule"] and tokens[i]]
    for i, r in rows.items():
        if r["rule"] is None and r["mined"]:
            need = set(r["mined"])
            votes = [v for t, v in known if need <= t]
            assert need <= tokens[i] and votes.count(r["verdict"]) >= 0.8 * len(votes) and len(votes) >= 0.05 * len(known)
    assert any(r["mined"] for r in rows.values())
    assert urlrules.judge(pages.limit(0)).count() == 0


def test_pipeline_follows_its_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = {r[0] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
    good = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    named = partenum.near_duplicates(docs.where(F.col("doc_id").isin(list(good))), numerator=8, denominator=10, words=5)
    first = {r["doc_id"] for r in named.where("doc_id = component_id").collect()}
    found = decontaminate.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = {r["doc_id"] for r in found.where(decontaminate.is_contaminated(decontaminate.hit_words("spans"), F.col("n_words"))).collect()}
    assert packed <= first - dirty and len(first - dirty - packed) <= 2
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "decontamination", "packing"]
