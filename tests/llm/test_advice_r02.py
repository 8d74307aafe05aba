"""Cases of the second review: each failed before its finding was settled."""

import random

from pyspark.sql import functions as F

from sondage.llm import decontaminate, language, partenum, toxicity
from sondage.llm.queries import CASES, ORACLES
from tools.compare import compare


def test_decontamination_keeps_the_bytes_85_and_a0_in_words(spark, tmp_path):
    import duckdb

    french = "Il va à la gare à midi et à Paris voilà déjà la fin à voir"
    russian = "Работа хорошо идёт Рано утром хорошая погода Россия и хлеб Рядом с рекой хата стоит"
    chinese = "中國酠酅 腠腅 頠項 蠠蠅"
    items = [(1, french), (2, russian), (3, chinese), (4, "Рано хорошо")]
    docs = [(1, french + " puis autre chose"), (2, "début à côté " + french), (3, russian), (4, f"слова Рано хорошо {russian} Рука"),
            (5, chinese + " x"), (6, "a Рано хорошо b"), (7, "P а н о х о р о ш о"), (8, "Рано, хорошо à"), (9, "à"), (10, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert compare(CASES["op1_decontamination"](spark, str(tmp_path)), connection, ORACLES["op1_decontamination"]) is None
    assert len(decontaminate.item_words(french)) == 16 and len(decontaminate.item_words("國酠酅腠")) == 1
    found = {r["doc_id"]: r["spans"] for r in decontaminate.find_items(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for i, start, stop in ((1, 0, len(french)), (2, 13, 13 + len(french)), (6, 2, 13), (8, 0, 12)):
        assert [(s["start_char"], s["stop_char"]) for s in found[i]] == [(start, stop)]


def test_language_rejects_foreign_texts_although_junk_trains(spark):
    rnd = random.Random(3)

    def letters(n):
        return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 10))) for _ in range(n))

    russian = "время человек работа город жизнь большой новый дом рука дело слово место вода земля река погода".split()
    italian = "il che di per non sono della più come anche nel questo gli città vita uomo giorno strada lavoro libro".split()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = [(-i, text, lang) for i, (lang, text) in enumerate(
        (lang, text) for lang in ("en", "fr", "de", "es") for text in (
            "x", "A.", "zq " * 3000, "qx. " * 300, letters(200), "".join(rnd.choice("бгджз") for _ in range(500))))]
    model = language.train(docs.unionByName(spark.createDataFrame(junk, docs.schema)))
    texts = [make(n) for n in (60, 300, 1000) for make in (
        letters, lambda n: " ".join(rnd.choices(russian, k=n)), lambda n: " ".join(rnd.choices(italian, k=n)))]
    foreign = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert language.identify(foreign, model).where("not rejected").count() == 0
    own = language.identify(docs, model)
    assert own.where("rejected").count() <= 0.01 * own.count()


def test_samples_hold_distinct_texts_whatever_the_copies(spark):
    texts = spark.range(400).select((F.col("id") % 2).cast("int").alias("label"), F.concat(F.lit("text "), "id").alias("text"))
    draw = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 20))
    hot = texts.orderBy(draw).limit(1)
    rows = texts.unionByName(hot.crossJoin(spark.range(3000)).drop("id")).repartition(7)
    found = toxicity.sample_by_label(rows, 40)
    counts = {r["label"]: (r["n"], r["d"]) for r in found.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("d")).collect()}
    assert set(counts) == {0, 1} and all(n == d and 20 <= n <= 80 for n, d in counts.values())
    again = toxicity.sample_by_label(rows.repartition(3), 40)
    assert sorted(found.collect()) == sorted(again.collect())


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    text = " ".join(f"word{k}" for k in range(100))
    other = " ".join(f"thing{k}" for k in range(100))
    rows = [(1, text, "a"), (5, text + " more", "b"), (5, other, "c"), (7, "one two three four five six", "d"),
            (7, "one two three four five six", "e"), (None, text, "f"), (None, "nothing like the rest of it at all", "g"), (8, None, "h"),
            (8, " ", "i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, cls string").repartition(3)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in partenum.keep_one(docs, numerator=8, denominator=10, words=5).collect())
    assert got == sorted([(1, text), (5, other), (7, rows[3][1]), (0, rows[6][1]), (8, ""), (8, " ")])


def test_sets_are_one_row_per_class(spark):
    base = [f"word{k}" for k in range(100)]
    texts = [" ".join(base), " ".join([*base, "end"])]
    rows = [(None, texts[k % 2]) for k in range(60)] + [(3, texts[k % 2]) for k in range(40)]
    run = partenum.Join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "doc_id", "text", 9, 10, 3, 0)
    members = run.documents()
    assert run.sets(members.select("cls").distinct(), members).count() == 2
    named = partenum.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["component_id"] for r in named.collect()} == {3} and named.count() == 100
