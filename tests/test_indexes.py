"""Indexes give what a full scan gives; probing alone finds nine in ten or more; files of any size are classified."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators.text_index import TextIndex
from sondage.operators.vector_index import VectorIndex
from sondage.sources import files


def plain_topk(rows, question, k):
    def cosine(v):
        a, b = np.linalg.norm(v), np.linalg.norm(question)
        return float(np.dot(v, question) / (a * b)) if a and b else 0.0
    ranked = sorted(((-round(cosine(np.array(v)), 9), i) for i, v in rows if v is not None))
    return [i for _, i in ranked[:k]]


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 8))
    rows = [(k, (centres[k % 12] + 0.5 * rnd.normal(size=8)).tolist()) for k in range(1500)]
    rows += [(2000 + k, [1.0] + [0.0] * 7) for k in range(300)] + [(3000, [0.0] * 8), (3001, [0.0] * 8), (3002, None)]
    return rows, spark.createDataFrame(rows, "id bigint, v array<double>").repartition(4)


def test_vector_index(spark, vectors, tmp_path):
    rows, frame = vectors
    index = VectorIndex.build(frame, str(tmp_path / "index"), "id", "v")
    assert spark.read.parquet(f"{index.path}/rows").count() == len(rows) - 1
    rnd = np.random.default_rng(4)
    questions = [(q, rnd.normal(size=8).tolist()) for q in range(12)] + [(50, [1.0] + [0.0] * 7), (51, [0.0] * 8), (52, [-x for x in rows[0][1]])]
    want = {q: plain_topk(rows, np.array(v), 10) for q, v in questions}

    def ranked(found):
        got = {}
        for r in found.orderBy("question_id", "rank").collect():
            got.setdefault(r["question_id"], []).append(r["key"])
        return got

    assert ranked(index.search(questions, 10, probes=2, exact=True)) == want
    probed = ranked(index.search(questions[:12], 10, probes=12))
    assert sum(len(set(probed[q]) & set(want[q])) for q in range(12)) >= 0.9 * 120
    # Few of the cells are read: that is what an index is for.
    plan = index.search(questions[:1], 10, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan or "PushedFilters: [IsNotNull(cell), In(cell" in plan or "PushedFilters: [Or(" in plan


def test_vector_index_of_nothing(spark, tmp_path):
    frame = spark.createDataFrame([(1, None)], "id bigint, v array<double>")
    index = VectorIndex.build(frame, str(tmp_path / "none"), "id", "v")
    assert index.search([(1, [1.0, 0.0])], 3, exact=True).count() == 0


def test_text_index_equals_a_scan(spark, tmp_path):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abAB é.") for _ in range(rnd.randrange(40))) for _ in range(300)] + ["", None, "ab", "The END of it", "x" * 50_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string").repartition(3)
    index = TextIndex.build(frame.withColumnRenamed("key", "gram"), str(tmp_path / "text"), "gram", F.col("text"))
    for query in ["", "a", "É", "aB", "aba", "ab a", "A.éb", "end of", "xxx", "zzz", "abababab", "a" * 12]:
        want = sorted(k for k, t in enumerate(texts) if t is not None and query.lower() in t.lower())
        assert sorted(r["key"] for r in index.holding(query).collect()) == want, query


def test_files_of_any_size_are_classified(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    with open(tmp_path / "large", "wb") as file:
        file.write(b"PK\x03\x04")
        file.truncate(3 << 30)  # a sparse file: it takes no room
    (tmp_path / "a" / "b" / "x.CSV").write_text("a,b\n")
    (tmp_path / "a" / "y").write_bytes(b"\x1f\x8b..")
    (tmp_path / "a" / ".json").write_text('{"a": 1}')
    (tmp_path / "empty").write_text("")
    found = {r["path"]: (r["length"], r["ext"], r["file_type"]) for r in files.file_manifest(spark, str(tmp_path), sniff=True).collect()}
    assert found == {"large": (3 << 30, "", "zip"), "a/b/x.CSV": (4, "csv", "csv"), "a/y": (4, "", "gzip"), "a/.json": (8, "", "json"),
                     "empty": (0, "", "unknown")}
    listed = files.file_manifest(spark, f"file://{tmp_path}").where("file_type = 'unknown'")
    assert listed.count() == 4 and math.isclose(files.file_manifest(spark, str(tmp_path / "large"), sniff=True).first()["length"], 3 << 30)


def test_a_question_finds_the_candidates_that_share_its_words(spark):
    from sondage.operators import search

    rows = [(1, "rain and snow", None, 5, 1, 1), (2, "rain in spring", "how much rain falls in spring", 2000, 9, 50), (3, "", "", 0, 0, 0),
            (4, "stock prices", "by day", 0, 0, 0)]
    frame = spark.createDataFrame(rows, "id bigint, title string, description string, download_count bigint, usability_rating bigint, vote_count bigint")
    got = search.select_for_question(frame, "how much rain falls in spring", "id", k=2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 1] and got[0]["similarity_score"] > 0.7 > got[1]["similarity_score"]
    assert got[0]["selection_reason"].startswith("High semantic similarity") and got[1]["selection_reason"].startswith("Selected based")


def test_long_texts_are_indexed_in_time_with_their_length(spark, tmp_path):
    from time import monotonic

    # A walk from the text's beginning to each of its grams takes minutes for these.
    texts = ["".join(chr(97 + (i * i // 7 + k) % 26) for i in range(400_000)) + f"end{k}😀é" for k in range(4)]
    frame = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string").repartition(4)
    begun = monotonic()
    index = TextIndex.build(frame, str(tmp_path / "long"), "key", F.col("text"))
    assert [r["key"] for r in index.holding("D2😀É").collect()] == [2]
    assert monotonic() - begun < 60
    postings = {(r["key"], r["gram"]) for r in spark.read.parquet(str(tmp_path / "long/postings")).collect()}
    assert postings == {(k, t[i:i + 3]) for k, t in enumerate(texts) for i in range(len(t) - 2)}
