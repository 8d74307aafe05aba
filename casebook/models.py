"""Model comparison, tuning, validation: the whole table goes in, scores come out."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from sondage.operators import models

from .registry import case, table


def _segments(spark, sf_dir):
    """Customers by segment: five classes."""
    df = table(spark, sf_dir, "customer")
    return models.prepare(df, "c_mktsegment", ["c_nationkey", "c_acctbal"], "classification", ["c_custkey"])


def _prices(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return models.prepare(df, "p_retailprice", ["p_partkey", "p_size"], "regression", ["p_partkey"])


def _quality(spark, sf_dir):
    """Labelled documents: two classes from the length and the toxicity flag."""
    df = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return models.prepare(df, "quality", ["toxic", "n_chars"], "classification", ["doc_id"])


@case("compare_classifiers")
def compare_classifiers(spark, sf_dir):
    return models.compare_classifiers(_quality(spark, sf_dir), 2, 2)


@case("compare_regressors")
def compare_regressors(spark, sf_dir):
    return models.compare_regressors(_prices(spark, sf_dir))


@case("tune_grid")
def tune_grid(spark, sf_dir):
    data = _segments(spark, sf_dir)
    model = LogisticRegression(maxIter=1000, standardization=False)
    grid = models.tuning_grid("Logistic Regression", model, "classification", data.count(), 2, 5)
    return models.tune_grid(data, model, grid, "classification", 0.2)[0]


@case("tune_random")
def tune_random(spark, sf_dir):
    data = _quality(spark, sf_dir)
    model = LogisticRegression(maxIter=1000, standardization=False)
    grid = models.tuning_grid("Logistic Regression", model, "classification", data.count(), 2, 2)
    return models.tune_random(data, model, grid, "classification", 0.5, 3)[0]


@case("validate_holdout")
def validate_holdout(spark, sf_dir):
    return models.validate_holdout(_quality(spark, sf_dir), LogisticRegression(maxIter=1000), "classification", "doc_id")


@case("validate_holdout_regression", """
    WITH p AS (SELECT p_partkey::DOUBLE AS x, p_size::DOUBLE AS z, p_retailprice AS y,
          row_number() OVER (ORDER BY md5(p_partkey || '_42'), p_partkey) <= ceil(0.2 * COUNT(*) OVER ()) AS is_test FROM part),
      m AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz,
          covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, COUNT(*) AS train_size FROM p WHERE NOT is_test),
      b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM m),
      e AS (SELECT y, y - (my + bx * (x - mx) + bz * (z - mz)) AS e, train_size FROM p, b WHERE is_test)
    SELECT ROUND(1 - avg(e * e) / var_pop(y), 6) AS r2_score, ROUND(avg(e * e), 4) AS mean_squared_error,
      ROUND(sqrt(avg(e * e)), 4) AS root_mean_squared_error, ROUND(avg(abs(e)), 4) AS mean_absolute_error,
      any_value(train_size) AS train_size, COUNT(*) AS test_size FROM e""")
def validate_holdout_regression(spark, sf_dir):
    found = models.validate_holdout(_prices(spark, sf_dir), LinearRegression(), "regression", "p_partkey")
    errors = ["mean_squared_error", "root_mean_squared_error", "mean_absolute_error"]
    return found.withColumns({"r2_score": F.round("r2_score", 6), **{c: F.round(c, 4) for c in errors}})
