"""The perceptron on blocks takes MLlib's steps, for all folds in one scan."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sondage.operators import models, perceptron


def rows(spark, n, parts=1):
    df = spark.range(0, n, 1, parts).select(
        "id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"), (F.col("id") % 5).cast("int").alias("fold")).withColumn(
        "label", F.when(F.col("a") + 0.3 * F.col("b") > 0.4, 2.0).when(F.col("b") > 0.2, 1.0).otherwise(0.0))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).persist()


def test_steps_are_those_of_mllib(spark):
    data = rows(spark, 256)  # two of MLlib's blocks, both full
    args = {"layers": [2, 6, 4, 3], "maxIter": 30, "seed": 42}
    theirs, ours = MultilayerPerceptronClassifier(**args).fit(data), perceptron.BlockPerceptron(**args).fit(data)
    assert type(ours) is type(theirs) and ours.getMaxIter() == 30
    assert ours.weights.toArray() == pytest.approx(theirs.weights.toArray(), rel=1e-4, abs=1e-4)
    assert ours.summary().objectiveHistory == [pytest.approx(theirs.summary().objectiveHistory[-1], rel=1e-6)]
    assert theirs.summary().objectiveHistory[-1] < 0.7 * theirs.summary().objectiveHistory[0]


@pytest.mark.parametrize("close", [64, 2])  # with 2, tasks add up the sums of the parts
def test_folds_in_one_scan_are_folds_alone(spark, monkeypatch, close):
    monkeypatch.setattr(perceptron, "CLOSE_PARTS", close)
    monkeypatch.setattr(perceptron, "BLOCK_ROWS", 7)
    data = rows(spark, 300, 6)
    model = perceptron.BlockPerceptron(layers=[2, 5, 3], maxIter=12, seed=1)
    for fold, fitted in enumerate(model.fit_folds(data, "fold", list(range(5)))):
        alone = model.fit(data.where(F.col("fold") != fold))
        assert fitted.weights.toArray() == pytest.approx(alone.weights.toArray(), rel=1e-6, abs=1e-8)


def test_a_comparison_fits_the_folds_of_a_network_in_one_job(spark):
    data, seen = rows(spark, 100), []

    class Half:
        def transform(self, test):
            return test.withColumn("prediction", F.col("label"))

    class Joint:
        def fit_folds(self, train, fold, folds):
            seen.append((train.count(), fold, folds))
            return [Half()] * len(folds)

    scores = models.cross_validate(data, {"joint": Joint()}, "classification").collect()
    assert [(r["model"], r["fold"], r["score"], r["error"]) for r in scores] == [("joint", k, 1.0, None) for k in range(5)]
    assert seen == [(100, "fold", [0, 1, 2, 3, 4])]
    assert hasattr(models.classifiers(2, 2)["Neural Network"], "fit_folds")


def test_a_row_that_no_network_can_learn_fails_the_folds_that_train_on_it(spark):
    data = rows(spark, 100).withColumn("label", F.when(F.col("id") == 0, 3.0).otherwise(F.col("label")))  # in fold 0
    model = perceptron.BlockPerceptron(layers=[2, 4, 3], maxIter=3, seed=1)
    scores = models.cross_validate(data, {"network": model}, "classification").collect()
    assert [r["score"] is None for r in scores] == [False, True, True, True, True]
    assert all("from 0 to 2" in r["error"] for r in scores[1:])


def run(search, f):
    return perceptron.together({0: search}, lambda points: {0: f(points[0])})[0]


def test_the_optimizer_ends_where_it_should():
    def valley(x):
        value = (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2
        return value, np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])

    x, values = run(perceptron.minimise(np.array([-1.2, 1.0]), 100, 1e-12), valley)
    assert x == pytest.approx([1, 1], abs=1e-4) and values[-1] < 1e-8 and len(values) < 60
    assert len(run(perceptron.minimise(np.array([-1.2, 1.0]), 7, 1e-12), valley)[1]) == 8
    start, values = run(perceptron.minimise(np.ones(2), 9, 1e-6), lambda x: (np.nan, x * np.nan))
    assert list(start) == [1, 1] and len(values) == 1


def test_a_network_is_sure_without_overflow():
    network = perceptron.Network([1, 1, 2], np.array([2000.0, 0.0, 3000.0, -3000.0, 0.0, 0.0]))
    loss = network.add(np.array([[1.0, -1.0], [1.0, 1.0]]), np.array([0, 1]))
    assert loss == pytest.approx(np.log(2)) and np.isfinite(network.gradient()).all()
