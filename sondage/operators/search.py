"""Ranking candidates against questions, and the keyed lookups around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import file_stem, selection_reason
from ..functions.vectors import COMPARE_DECIMALS, cosine_to, hashing_encode


def semantic_rank(candidates: DataFrame, question: list[float], vector: str = "embedding") -> DataFrame:
    """Every candidate with its similarity to one question; the question travels as a constant."""
    return candidates.withColumn("similarity", cosine_to(F.col(vector), question))


def semantic_topk(candidates: DataFrame, question: list[float], k: int, key: str, vector: str = "embedding") -> DataFrame:
    """The k most similar candidates, smallest key first on ties: a top-k per task, no full sort."""
    ranked = semantic_rank(candidates, question, vector).drop(vector)
    return ranked.orderBy(F.desc(F.round("similarity", COMPARE_DECIMALS)), F.asc(key)).limit(k)


def select_for_question(candidates: DataFrame, question: str, key: str, k: int = 3, title: str = "title", description: str = "description",
                        downloads: str = "download_count", usability: str = "usability_rating", votes: str = "vote_count",
                        encode: Callable[[DataFrame, str, str], DataFrame] = hashing_encode) -> DataFrame:
    """The k candidates nearest to a question in words, with ``similarity_score``, ``rank`` and ``selection_reason``.

    Question and candidates (title, a space, description) go through the same encoder, ``encode(df, text,
    output)``, which must encode row by row alike in any frame. Equal scores go by key.
    """
    spark = candidates.sparkSession
    asked = encode(spark.createDataFrame([(question,)], "text string"), "text", "vector").first()["vector"]
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    held = F.struct(*[F.col(c) for c in (key, title, downloads, usability, votes)])
    encoded = encode(candidates.select(held.alias("held"), F.col(key).alias("key"), text.alias("text")), "text", "vector")
    best = semantic_topk(encoded.select("held", "key", "vector"), [float(x) for x in asked], k, "key", "vector")
    order = Window.orderBy(F.desc(F.round("similarity", COMPARE_DECIMALS)), F.asc("key"))  # of k rows
    return best.select(
        "held.*", F.col("similarity").alias("similarity_score"), F.row_number().over(order).alias("rank"),
        selection_reason(F.col("similarity"), F.col(f"held.{downloads}"), F.col(f"held.{usability}"), F.col(f"held.{votes}"))
        .alias("selection_reason"))


def topk_per_question(candidates: DataFrame, questions: list[tuple[int, list[float]]], k: int, key: str,
                      vector: str = "embedding") -> DataFrame:
    """``(question_id, key, similarity, rank)``: the k best candidates of each of many questions.

    Each task scores its batches against all question vectors with one matrix
    product and keeps a running top k per question, so a task shuffles at most
    k rows per question whatever the number of candidates.
    """
    ids = np.array([q for q, _ in questions], dtype="int64")
    matrix = np.array([v for _, v in questions], dtype="float64")
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    units = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)
    key_type = candidates.schema[key].dataType
    schema = T.StructType([T.StructField("question_id", T.LongType()), T.StructField(key, key_type),
                           T.StructField("similarity", T.DoubleType())])

    def best_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame | None] = [None] * len(ids)
        for batch in batches:
            batch = batch.dropna()
            if batch.empty:
                continue
            vectors = np.stack(batch[vector].to_numpy()).astype("float64")
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            scores = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0) @ units.T
            for j in range(len(ids)):
                rows = pd.DataFrame({key: batch[key].to_numpy(), "similarity": scores[:, j]})
                if kept[j] is not None:
                    rows = pd.concat([kept[j], rows], ignore_index=True)
                rows["_order"] = -rows["similarity"].round(COMPARE_DECIMALS)
                kept[j] = rows.sort_values(["_order", key]).head(k)[[key, "similarity"]]
        for j, rows in enumerate(kept):
            if rows is not None:
                yield rows.assign(question_id=ids[j])[["question_id", key, "similarity"]]

    best = candidates.select(key, vector).mapInPandas(best_of_task, schema)
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("similarity", COMPARE_DECIMALS)), F.asc(key))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def question_candidates(candidates: DataFrame, questions: list[tuple[int, str]]) -> DataFrame:
    """Each candidate beside each of a short list of questions, which travel as constants."""
    listed = F.array(*[F.struct(F.lit(q).alias("question_id"), F.lit(t).alias("question")) for q, t in questions])
    return candidates.select("*", F.inline(listed))


def text_contains_search(df: DataFrame, text: Column, query: str, k: int, order: str) -> DataFrame:
    """First k rows whose text holds the query, ignoring case."""
    hits = df.where(F.contains(F.lower(text), F.lit(query.lower())))
    return hits.orderBy(order).limit(k)


def search_similar_insights(df: DataFrame, kind: Column, question: list[float] | None, query: str, text: Column,
                            k: int, key: str, vector: str = "embedding") -> DataFrame:
    """The k nearest records of one kind; without a question vector, the substring search."""
    wanted = df.where(kind)
    if question is None:
        return text_contains_search(wanted, text, query, k, key)
    return semantic_topk(wanted, question, k, key, vector)


def join_hits_to_records(hits: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Stored records of the ranked hits; hits without a record are dropped."""
    return records.join(hits, key, "inner")


def join_params_to_model(params: DataFrame, models: DataFrame, key: str = "file_path") -> DataFrame:
    return params.join(models, key, "inner")


def join_model_to_table(models: DataFrame, tables: DataFrame, model_path: str = "file_path",
                        table_path: str = "path", position: str = "position") -> DataFrame:
    """The first table whose stem (without ``_processed``) occurs in the model's path.

    "Occurs in" becomes an equality: each path is split into its substrings of
    the few lengths that stems have, and those are matched to the stems.
    """
    stems = tables.withColumn("_stem", F.replace(file_stem(F.col(table_path)), F.lit("_processed"), F.lit("")))
    firsts = stems.groupBy("_stem").agg(
        F.min_by(table_path, position).alias("processed_path"), F.min(position).alias("_position"))
    lengths = [r[0] for r in stems.select(F.length("_stem").alias("n")).distinct().collect() if r[0]]
    path = F.col(model_path)
    none = F.array().cast("array<string>")

    def pieces_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(path) - n + 1)
        return F.when(F.length(path) >= n, F.transform(starts, lambda i: F.substring(path, i, F.lit(n)))).otherwise(none)

    pieces = F.concat(none, *[pieces_of(n) for n in lengths])
    found = (
        models.select(model_path, F.explode(F.array_distinct(pieces)).alias("_stem"))
        .join(firsts, "_stem")
        .groupBy(model_path).agg(F.min_by("processed_path", "_position").alias("processed_path"))
    )
    return models.join(found, model_path, "inner")
