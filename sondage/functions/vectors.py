"""Vectors: cosine similarity as an expression, and text encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .text import words

COMPARE_DECIMALS = 9  # scores are ordered at this precision, so the order of summation cannot decide


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def vector_literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cosine_similarity(a: Column, b: Column) -> Column:
    """Dot product over the norms; 0 when either norm is 0."""
    return F.coalesce(F.try_divide(_dot(a, b), norm(a) * norm(b)), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def cosine_to(a: Column, question: list[float]) -> Column:
    """Cosine with one fixed vector, whose norm is worked out once."""
    length = float(np.linalg.norm(np.asarray(question, dtype="float64")))
    if length == 0.0:
        return F.when(a.isNotNull(), F.lit(0.0))
    unit = vector_literal([v / length for v in question])
    return F.coalesce(F.try_divide(_dot(a, unit), norm(a)), F.when(a.isNotNull(), F.lit(0.0)))


def hashing_encode(df: DataFrame, text: str, output: str = "embedding", dimensions: int = 256) -> DataFrame:
    """Default encoder: unit-length hashed word counts, computed in the JVM over the whole text."""
    stages = Pipeline(stages=[
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions),
        Normalizer(inputCol="_counts", outputCol="_unit"),
    ])
    source = df.withColumn("_words", words(F.coalesce(F.col(text), F.lit(""))))
    encoded = stages.fit(source).transform(source)
    return encoded.withColumn(output, vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")


def encoder_udf(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A column function from a model: ``load`` runs once per task and returns the batch encoder."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            matrix = np.asarray(model(batch.fillna("").tolist()), dtype="float32")
            yield pd.Series(list(matrix), index=batch.index)

    return encode
