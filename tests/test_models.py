"""Models beat a constant guess; metrics agree with MLlib's; a failing model is recorded."""

import json

import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from sondage.operators import models, registry
from sondage.plans.pipeline import run_analysis, run_tables


@pytest.fixture(scope="module")
def two_classes(spark):
    df = spark.range(200).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b")).withColumn(
        "y", F.when(F.col("a") + 0.3 * F.col("b") > 0, "yes").otherwise("no"))
    return models.prepare(df, "y", ["a", "b"], "classification", ["id"]).persist()


def test_cross_validation_beats_the_majority_and_keeps_failures(two_classes):
    scores = models.cross_validate(two_classes, {
        "good": LogisticRegression(), "bad": LogisticRegression(featuresCol="absent")}, "classification")
    stats = {r["model"]: r for r in models.cv_score_stats(scores).collect()}
    assert stats["good"]["mean_score"] > 0.9 and stats["good"]["folds"] == 5
    assert stats["bad"]["mean_score"] is None and stats["bad"]["error"]
    assert models.recommend_model(models.cv_score_stats(scores), "classification").first()["model_name"] == "good"


def test_grid_search(two_classes):
    model = LogisticRegression(maxIter=50, standardization=False)
    grid = models.tuning_grid("Logistic Regression", model, "classification", 200, 2, 2)
    table, best = models.tune_grid(two_classes, model, grid, "classification", 0.5)
    assert table.count() == 6 and table.where("best").count() == 1 and best in grid
    none, params = models.tune_grid(two_classes, LogisticRegression(), [], "classification", 0.5)
    assert params == {} and none.first()["score"] == 0.5


def test_forest_grid_has_every_combination():
    model = RandomForestClassifier()
    assert len(models.tuning_grid("Random Forest", model, "classification", 10, 2, 2)) == 36


def test_metrics_equal_the_evaluators(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("double").alias("label"), (F.col("id") * 7 % 4).cast("double").alias("prediction"))
    ours = models.classification_metrics(df).first()
    for name, theirs in {"accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall", "f1_score": "f1"}.items():
        assert ours[name] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(df))
    row = models.regression_metrics(df).first()
    for name, theirs in {"r2_score": "r2", "mean_squared_error": "mse", "root_mean_squared_error": "rmse", "mean_absolute_error": "mae"}.items():
        assert row[name] == pytest.approx(RegressionEvaluator(metricName=theirs).evaluate(df))


def test_holdout_is_a_fifth_of_each_class(two_classes):
    row = models.validate_holdout(two_classes, LogisticRegression(), "classification", "id").first()
    assert row["train_size"] + row["test_size"] == 200 and row["test_size"] in (40, 41, 42) and row["accuracy"] > 0.8


def test_whole_analysis_records_every_stage(spark, tmp_path):
    df = spark.range(300).select(
        "id", F.sin("id").alias("a"), F.when(F.col("id") % 9 == 0, None).otherwise(F.cos("id")).alias("b"),
        F.element_at(F.array(F.lit("u"), F.lit("v"), F.lit("w")), (F.col("id") % 3 + 1).cast("int")).alias("kind"),
        (F.sin("id") * 4 + F.col("id") * 0.01).alias("y"))

    def one_model(data, task, n_features, n_classes):
        return models.cross_validate(data, {"Gradient-Boosted Trees": GBTRegressor(maxIter=3)}, task, folds=3)

    results = run_analysis(df, "run1", "id", "y", str(tmp_path), compare=one_model, draws=2)
    status = {r["stage"]: (r["status"], r["payload"]) for r in results.collect()}
    assert {s for s, _ in status.values()} == {"success"}, status
    assert len(status) == 11
    assert spark.read.parquet(f"{tmp_path}/run1_findings.parquet").count() >= 2
    # What tuning found best is what validation fitted, and what was recommended is what was tuned.
    tuned, checked = (json.loads(status[s][1]) for s in ("hyperparameter_optimization", "model_validation"))
    best = spark.read.parquet(f"{tmp_path}/run1_tuning.parquet").where("best").collect()
    assert len(best) == 1 and registry.from_text(best[0]["params"]) == tuned["optimized_params"] == json.loads(checked["params"])
    assert tuned["model_name"] == checked["model_name"] == "Gradient-Boosted Trees"
    assert set(tuned["optimized_params"]) == {"n_estimators", "max_depth", "learning_rate"}
    report = {r["section"] for r in spark.read.parquet(f"{tmp_path}/run1_report.parquet").collect()}
    assert {"stages", "findings", "recommendations", "models"} <= report
    assert "significance_share" in json.loads(status["visualization"][1])["series"]


def test_a_failing_stage_is_recorded_and_the_others_run(spark):
    df = spark.range(50).select("id", F.sin("id").alias("a"), F.cos("id").alias("y"))

    def broken(*_):
        raise RuntimeError("no models today")

    status = {r["stage"]: r["status"] for r in run_analysis(df, "r", "id", "y", compare=broken).collect()}
    assert status["model_architecture"] == "failed" and status["insight_synthesis"] == "success"
    assert status["hyperparameter_optimization"] == status["model_validation"] == "failed" and status["visualization"] == "success"


@pytest.mark.parametrize("task,name", sorted(registry.MODELS))
def test_parameters_survive_the_way_to_mllib_and_back(spark, task, name):
    sizes = registry.Sizes(1000, 7, 3 if task == "classification" else 0)
    model = registry.find(task, name)
    for params in [*registry.grid(task, name), model.recommended, {}]:
        made = registry.estimator(task, name, params, sizes)
        back = registry.described(task, name, made, sizes)
        for key in set(params) & set(model.settings):
            assert back[key] == params[key] or float(back[key]) == pytest.approx(float(params[key]))
        again = registry.estimator(task, name, registry.from_text(registry.as_text(back)), sizes)
        assert registry.described(task, name, again, sizes) == back
    assert bool(registry.grid(task, name)) == (name != "Linear Regression")


def test_names_without_an_mllib_model_have_stand_ins(spark):
    assert registry.find("regression", "SVR").name == "Gradient-Boosted Trees"
    assert registry.find("regression", "Neural Network").name == "Factorization Machine"
    assert registry.find("classification", "who knows").name == "Random Forest"
    stats = spark.createDataFrame([(n, 0.5 + 0.01 * len(n), 0.1) for n in registry.names("regression")],
                                  "model string, mean_score double, std_score double")
    for name in registry.names("regression"):
        row = models.recommend_model(stats.where(F.col("model") == name), "regression").first()
        assert row["params"] == registry.find("regression", name).recommended


def test_a_tuned_model_is_validated_by_its_text(two_classes):
    table, best = models.tune_model(two_classes, "classification", "Logistic Regression", 0.5, 2, 2)
    assert table.count() == 6 and registry.from_text(table.where("best").first()["params"]) == best
    row = models.validate_model(two_classes, "classification", "Logistic Regression", best, "id", 2, 2).first()
    direct = models.validate_holdout(two_classes, registry.estimator(
        "classification", "Logistic Regression", best, registry.Sizes(200, 2, 2)), "classification", "id").first()
    assert row["accuracy"] == direct["accuracy"] > 0.8 and registry.from_text(row["params"]) == best
    none, params = models.tune_model(two_classes.withColumn("label", F.col("label") + F.rand(1)), "regression", "Linear Regression", 0.25, 2)
    assert params == {} and none.first()["score"] == 0.25


def test_classes_are_coded_in_the_table(spark):
    df = spark.range(60).select("id", F.sin("id").alias("a"), F.concat(F.lit("free text "), F.col("id") % 7).alias("y"))
    data = models.prepare(df, "y", ["a"], "classification", ["id"])
    assert sorted(r[0] for r in data.select("label").distinct().collect()) == [float(k) for k in range(7)]


def test_several_tables_are_rolled_up(spark):
    def none(*_):
        raise RuntimeError("no models today")

    df = spark.range(40).select("id", F.sin("id").alias("a"), F.cos("id").alias("y"))
    results, rollup = run_tables({"one": (df, "id", "y"), "two": (df.union(df.limit(5)), "id", "y")}, compare=none)
    assert results.count() == 22 and {r["run_id"] for r in results.select("run_id").distinct().collect()} == {"one", "two"}
    row = rollup.first()
    assert (row["total_files"], row["successful_files"], row["total_original_rows"], row["total_duplicates_removed"]) == (2, 2, 85, 5)


def test_fits_use_every_core_though_the_input_is_one_part(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F
    from sondage.operators import models

    rows = spark.range(100, numPartitions=1).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label"),
                                                    (F.col("id") % 5).cast("int").alias("fold"))
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    seen = []

    class Half:
        def fit(self, train):
            seen.append((train.rdd.getNumPartitions(), train.count()))
            return self

        def transform(self, test):
            return test.withColumn("prediction", F.col("label"))

    scores = models.cross_validate(data, {"half": Half()}, "classification").collect()
    assert [(r["fold"], r["score"], r["error"]) for r in scores] == [(k, 1.0, None) for k in range(5)]
    assert seen == [(spark.sparkContext.defaultParallelism, 80)] * 5
