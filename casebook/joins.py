"""Lookups between result collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.operators import search, stats

from .fixtures import shape, sql_shape
from .registry import case, table

_TABLES_SQL = """(SELECT 'data/processed/' || source || '_processed.csv' AS path, MIN(doc_id) AS position, source AS stem
                  FROM documents GROUP BY source)"""
_MODELS_SQL = "(SELECT 'data/cleaned/' || source || '_' || doc_id || '.csv' AS file_path FROM documents)"


@case("join_model_to_table", f"""
    SELECT file_path, processed_path FROM (
      SELECT m.file_path, t.path AS processed_path, row_number() OVER (PARTITION BY m.file_path ORDER BY t.position) AS rn
      FROM {_MODELS_SQL} m JOIN {_TABLES_SQL} t ON contains(m.file_path, t.stem)) WHERE rn = 1""")
def join_model_to_table(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    tables = documents.groupBy("source").agg(F.min("doc_id").alias("position")).select(
        F.concat(F.lit("data/processed/"), "source", F.lit("_processed.csv")).alias("path"), "position")
    models = documents.select(F.concat(
        F.lit("data/cleaned/"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("file_path"))
    return search.join_model_to_table(models, tables)


@case("join_params_to_model", f"""
    SELECT p.file_path, p.params, m.model_name FROM
      (SELECT 'data/' || o_custkey || '.csv' AS file_path, MAX(o_orderpriority) AS params FROM orders GROUP BY 1) p
      JOIN {sql_shape('metrics')} m ON p.file_path = m.file_path""")
def join_params_to_model(spark, sf_dir):
    params = table(spark, sf_dir, "orders").groupBy(
        F.concat(F.lit("data/"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("file_path")).agg(
        F.max("o_orderpriority").alias("params"))
    return search.join_params_to_model(params, shape(spark, sf_dir, "metrics")).select("file_path", "params", "model_name")


@case("join_hits_to_records", """
    WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 3),
    hits AS (SELECT e.vec_id AS insight_id, row_number() OVER (ORDER BY ROUND(list_cosine_similarity(
               list_transform(e.embedding, lambda x: x::DOUBLE), q.v), 9) DESC, e.vec_id) AS rank FROM embeddings e, q
             QUALIFY rank <= 50)
    SELECT h.insight_id, CAST(h.rank AS INT) AS rank, d.source AS title FROM hits h JOIN documents d ON d.doc_id = h.insight_id""")
def join_hits_to_records(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    question = list(vectors.where("vec_id = 3").first()["embedding"])
    hits = search.topk_per_question(vectors, [(0, question)], 50, "vec_id").select(F.col("vec_id").alias("insight_id"), "rank")
    records = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("insight_id"), F.col("source").alias("title"))
    return search.join_hits_to_records(hits, records, "insight_id").select("insight_id", "rank", "title")


QUESTIONS = [(1, "How do prices change over time?"), (2, "Which customers leave?")]


@case("question_cross_candidates", f"""
    SELECT c.doc_id, c.ref, q.id AS question_id, q.t AS question FROM {sql_shape('candidates')} c
    CROSS JOIN (VALUES (1, '{QUESTIONS[0][1]}'), (2, '{QUESTIONS[1][1]}')) q(id, t)""")
def question_cross_candidates(spark, sf_dir):
    return search.question_candidates(shape(spark, sf_dir, "candidates").select("doc_id", "ref"), QUESTIONS)


_NUMERIC = "event_id user_id amount rare one".split()
_NUMERIC_VALUES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(_NUMERIC))
_LONG = " UNION ALL ".join(f"SELECT event_id AS row_id, {i} AS i, '{c}' AS c FROM {sql_shape('gappy')} WHERE {c} IS NOT NULL"
                           for i, c in enumerate(_NUMERIC))


@case("column_pairs", f"""
    WITH long AS ({_LONG})
    SELECT a.c AS variable1, b.c AS variable2, COUNT(*) AS n FROM long a JOIN long b ON a.row_id = b.row_id AND a.i < b.i
    GROUP BY 1, 2""")
def column_pairs(spark, sf_dir):
    return stats.column_pairs(shape(spark, sf_dir, "gappy"))


@case("num_by_cat_grid", f"""
    WITH long AS ({_LONG})
    SELECT a.c AS dependent_variable, b.c AS independent_variable, COUNT(*) AS n FROM long a
    JOIN (SELECT event_id, 'kind' AS c FROM {sql_shape('gappy')} WHERE kind IS NOT NULL
          UNION ALL SELECT event_id, 'parity' FROM {sql_shape('gappy')}) b ON a.row_id = b.event_id GROUP BY 1, 2""")
def num_by_cat_grid(spark, sf_dir):
    return stats.num_by_cat_grid(shape(spark, sf_dir, "gappy"))
