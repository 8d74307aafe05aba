"""Model comparison, tuning and validation with MLlib."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import replace
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, functions as F

from . import registry
from ..ordering import Lookup, cut_keys, lookup_join, running_sums
from ..schema import family, numeric_columns, present, quoted, string_columns
from .clean import impute_mean, impute_target
from .features import label_codes, scale_standard
from .perceptron import BlockPerceptron
from .profile import small_cardinalities
from .stats import high_corr_pairs

SEED = registry.SEED
FOLDS = 5
CLASS_LIMIT = 10
SCORE_SCHEMA = "model string, fold int, score double, error string"

RECOMMENDED_PARAMS = {key: model.recommended for key, model in registry.MODELS.items()}
RECOMMENDATION_REASON = "Best cross-validation performance among tested models"


def task_type(df: DataFrame, target: str | None = None) -> str:
    """classification for a text target or one of at most ten distinct values."""
    target = target or df.columns[-1]
    if family(df.schema[target].dataType) == "string":
        return "classification"
    return "classification" if small_cardinalities(df, [target], CLASS_LIMIT)[target] is not None else "regression"


def data_characteristics(df: DataFrame) -> DataFrame:
    """Samples, features by family, missing values and strongly correlated pairs, as one row."""
    missing = F.lit(0)
    for c in df.columns:
        missing = missing + F.count_if(present(df, c).isNull())
    base = df.agg(F.count(F.lit(1)).alias("total_samples"), missing.alias("missing_values"))
    pairs = high_corr_pairs(df).agg(F.count(F.lit(1)).alias("high_corr_pairs")).first()[0]
    return base.select(
        "total_samples", F.lit(len(df.columns)).cast("bigint").alias("total_features"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_features"),
        F.lit(len(string_columns(df))).cast("bigint").alias("categorical_features"), "missing_values",
        F.lit(pairs).cast("bigint").alias("high_corr_pairs"),
    )


def hash_fold(keys: list[str], folds: int = FOLDS, quote: bool = True) -> Column:
    """A fold per row from a hash of its key: no shuffle, stable across runs. Without ``quote`` a key may be a field."""
    return F.pmod(F.xxhash64(*[quoted(k) if quote else F.col(k) for k in keys]), F.lit(folds)).cast("int")


def _row_key(df: DataFrame, *order: Column) -> Column:
    """The order columns, then a hash of the whole row: only equal rows have equal keys, and these go together."""
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(*[quoted(c) for c in df.columns]).alias("row"))


def _passed(df: DataFrame, group: Column, key: Column, wanted: DataFrame, sizes: tuple[int, int], name: str, as_fold: bool) -> DataFrame:
    """Mark each row with how many of its group's cuts its key has reached (or whether it lies before the first).

    The cuts are read off a sort of groups and keys alone; the marks are a look-up and a comparison.
    """
    table = cut_keys(df, group, key, wanted).join(wanted.groupBy("group").agg(F.first("n").alias("n")), "group")
    held = F.struct(*[quoted(c) for c in df.columns])
    marked = lookup_join(df.select(held.alias("held"), group.alias("of"), key.alias("key")), Lookup(table, *sizes), F.col("of"), "group", ["cuts"])
    cuts = F.coalesce(F.map_values("cuts"), F.array())
    reached = F.size(F.filter(cuts, lambda cut: F.col("key") >= cut))
    mark = reached.cast("int") if as_fold else (reached == 0)
    return marked.select("held.*", mark.alias(name))


def kfold_assign(df: DataFrame, order: str, folds: int = FOLDS) -> DataFrame:
    """Contiguous folds in row order; the first ``n % folds`` folds hold one row more."""
    n = df.count()
    small, extra = divmod(n, folds)
    starts = [f * small + min(f, extra) for f in range(1, folds)]
    wanted = df.sparkSession.createDataFrame([("all", 0, f, start, n) for f, start in enumerate(starts) if start < n],
                                             "group string, start bigint, number int, place bigint, n bigint")
    return _passed(df, F.lit("all"), _row_key(df, quoted(order)), wanted, (1, n), "fold", True)


def stratified_kfold_assign(df: DataFrame, order: str, label: str, folds: int = FOLDS) -> DataFrame:
    """Contiguous folds within each class.

    Classes stand in order of first appearance; each class gets the fold sizes
    that dealing the sorted labels round-robin would give it.
    """
    # A struct around the label keeps rows without one as a class of their own.
    group = F.struct(quoted(label).alias("label"))
    classes = df.groupBy(group.alias("group")).agg(F.min(_row_key(df, quoted(order))).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = classes.withColumn("all", F.lit(0))
    placed, totals = running_sums(classes, [F.col("all"), F.col("first")], ["n"], "all")
    if not totals:
        return df.withColumn("fold", F.lit(0))

    def dealt(upto: Column, fold: int) -> Column:
        """How many of the first ``upto`` sorted labels go to this fold."""
        return F.floor((upto - fold + (folds - 1)) / folds)

    place, ends = F.lit(0), []
    for f in range(folds - 1):
        place = place + dealt(F.col("_n") + F.col("n"), f) - dealt(F.col("_n"), f)
        ends.append(F.struct(F.lit(f).alias("number"), place.cast("long").alias("place")))
    # Keys are sorted by class, so a class begins after the smaller ones; folds go by first appearance.
    sorted_classes, _ = running_sums(placed.select("group", "n", F.col("_n").alias("dealt"), F.lit(0).alias("all")),
                                     [F.col("all"), F.col("group")], ["n"], "all")
    begun = sorted_classes.select("group", F.col("_n").alias("start"), "n", F.col("dealt").alias("_n"))
    wanted = begun.select("group", "start", "n", F.inline(F.array(*ends))).where("place < n")
    return _passed(df, group, _row_key(df, quoted(order)), wanted, (totals[0]["rows"], totals[0]["n"]), "fold", True)


def stratified_split(df: DataFrame, key: str, label: str | None = None, share: float = 0.2,
                     seed: int = SEED) -> DataFrame:
    """Mark a hold-out of ``ceil(share * n)`` rows per class as ``is_test``.

    Rows are ranked by a seeded hash of their key within their class. Only rows that
    are equal in all columns share a place.
    """
    group = F.struct((quoted(label) if label else F.lit("all")).alias("label"))
    draw = F.md5(F.concat_ws("_", quoted(key).cast("string"), F.lit(str(seed))))
    classes = df.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    placed, totals = running_sums(classes, [F.col("all"), F.col("group")], ["n"], "all")
    if not totals:
        return df.withColumn("is_test", F.lit(False))
    wanted = placed.select("group", F.col("_n").alias("start"), F.lit(0).alias("number"),
                           F.ceil(F.lit(share) * F.col("n")).alias("place"), "n").where("place < n")
    return _passed(df, group, _row_key(df, draw, quoted(key)), wanted, (totals[0]["rows"], totals[0]["n"]), "is_test", False)


def prepare(df: DataFrame, target: str, features: list[str], task: str, key: list[str] | None = None) -> DataFrame:
    """Impute, scale and assemble: ``features``, ``label``, ``fold`` beside the key columns, which keep their own values
    even where they are features too."""
    held = df.select("*", F.struct(*[quoted(k).alias(f"k{i}") for i, k in enumerate(key)]).alias("_kept")) if key else df
    filled = impute_target(impute_mean(held, features), target, task)
    scaled = scale_standard(filled, [f for f in features if f != target])
    keyed = scaled.withColumn("fold", hash_fold([f"_kept.k{i}" for i in range(len(key))] if key else features, quote=not key))
    if family(df.schema[target].dataType) == "string" or task == "classification":
        codes = label_codes(keyed, target)  # stays a table, however many texts there are
        codes = replace(codes, table=codes.table.withColumn("label", F.col("code").cast("double")))
        keyed = lookup_join(keyed, codes, F.coalesce(quoted(target).cast("string"), F.lit("nan")), "value", ["label"])
    else:
        keyed = keyed.withColumn("label", quoted(target).cast("double"))
    assembled = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(keyed)
    return assembled.select(*[F.col(f"_kept.k{i}").alias(k) for i, k in enumerate(key or [])], "features", "label", "fold")


def classifiers(n_features: int, n_classes: int, max_iter: int = 500) -> dict[str, Estimator]:
    svm = LinearSVC(maxIter=100)
    return {
        "Random Forest": RandomForestClassifier(numTrees=100, seed=SEED),
        "Logistic Regression": LogisticRegression(maxIter=1000),
        "SVM": svm if n_classes == 2 else OneVsRest(classifier=svm),
        "Neural Network": BlockPerceptron(
            layers=[n_features, 100, 50, n_classes], maxIter=max_iter, seed=SEED),
    }


def regressors() -> dict[str, Estimator]:
    """MLlib has no kernel SVR or MLP regressor: boosted trees and factorisation machines take their places."""
    return {
        "Random Forest": RandomForestRegressor(numTrees=100, seed=SEED),
        "Linear Regression": LinearRegression(),
        "Gradient-Boosted Trees": GBTRegressor(seed=SEED),
        "Factorization Machine": FMRegressor(seed=SEED, stepSize=0.1),
    }


def _evaluator(task: str) -> Evaluator:
    if task == "classification":
        return MulticlassClassificationEvaluator(metricName="accuracy")
    return RegressionEvaluator(metricName="r2")


def _spread(data: DataFrame) -> DataFrame:
    """The rows held in memory, in a part per core at least: fits scan them hundreds of times, and a small file is one part."""
    parts = max(data.sparkSession.sparkContext.defaultParallelism, data.rdd.getNumPartitions())
    return data.repartition(parts).persist()


def cross_validate(data: DataFrame, models: dict[str, Estimator], task: str, folds: int = FOLDS,
                   parallelism: int = 8) -> DataFrame:
    """``(model, fold, score, error)``; a model that fails is kept with its error and no score.

    A model with ``fit_folds`` fits all folds in one job, which begins first; if that fails, fold by fold.
    """
    evaluator = _evaluator(task)
    cached = _spread(data)

    def score(name: str, fold: int, fit: Callable[[], Model]) -> tuple[str, int, float | None, str | None]:
        try:
            value = evaluator.evaluate(fit().transform(cached.where(F.col("fold") == fold)))
            return name, fold, float(value), None
        except Exception as error:  # recorded, so that the other models still run
            return name, fold, None, str(error)

    def scores(job: tuple[str, Estimator, list[int]]) -> list[tuple[str, int, float | None, str | None]]:
        name, model, held = job
        if len(held) > 1:
            try:
                return [score(name, fold, lambda: fitted) for fold, fitted in zip(held, model.fit_folds(cached, "fold", held))]
            except Exception:  # perhaps of rows that only some folds train on
                pass
        return [score(name, fold, lambda: model.fit(cached.where(F.col("fold") != fold))) for fold in held]

    joint = [(name, model, list(range(folds))) for name, model in models.items() if hasattr(model, "fit_folds")]
    jobs = joint + [(name, model, [fold]) for name, model in models.items() if not hasattr(model, "fit_folds") for fold in range(folds)]
    order = list(models)
    pool = ThreadPool(parallelism)
    try:
        rows = [row for found in pool.map(scores, jobs, chunksize=1) for row in found]
    finally:
        pool.close()
        cached.unpersist()
    return data.sparkSession.createDataFrame(sorted(rows, key=lambda row: (order.index(row[0]), row[1])), SCORE_SCHEMA)


def compare_classifiers(data: DataFrame, n_features: int, n_classes: int, max_iter: int = 500) -> DataFrame:
    return cross_validate(data, classifiers(n_features, n_classes, max_iter), "classification")


def compare_regressors(data: DataFrame) -> DataFrame:
    """R² of every regressor. It is the same for a standardised label, which gradient solvers need."""
    return cross_validate(unit_label(data)[0], regressors(), "regression")


def cv_score_stats(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of the fold scores of each model."""
    return scores.groupBy(*(by or ["model"])).agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"),
        F.count("score").alias("folds"), F.max("error").alias("error"))


def recommend_model(stats: DataFrame, task: str, by: list[str] | None = None) -> DataFrame:
    """The model with the highest mean score (first name on ties), its parameters and the reason."""
    rank = F.struct(F.coalesce(-F.col("mean_score"), F.lit(float("inf"))), "model")
    best = stats.groupBy(*(by or [])).agg(
        F.min_by(F.struct("model", "mean_score", "std_score"), rank).alias("best"))
    params = F.create_map(*[
        e for (kind, name), values in RECOMMENDED_PARAMS.items() if kind == task
        for e in (F.lit(name), F.create_map(*[F.lit(x) for kv in values.items() for x in kv]))
    ])
    return best.select(
        *(by or []), F.col("best.model").alias("model_name"), F.lit(task).alias("task_type"),
        F.col("best.mean_score").alias("cv_score"), F.col("best.std_score").alias("cv_std"),
        F.element_at(params, F.col("best.model")).alias("params"),
        F.lit(RECOMMENDATION_REASON).alias("recommendation_reason"))


def tuning_grid(name: str, model: Estimator, task: str, rows: int, n_features: int, n_classes: int) -> list[dict]:
    """MLlib's parameter maps of one model; an empty list where there is nothing to tune.

    C is a weight per row, so it becomes ``1 / (C * rows)`` here; a depth of
    None becomes 30, the deepest MLlib grows.
    """
    sizes = registry.Sizes(rows, n_features, n_classes)
    return [registry.param_map(registry.find(task, name), model, params, sizes) for params in registry.grid(task, name)]


def _param_text(param_map: dict) -> str:
    return ", ".join(f"{p.name}={v}" for p, v in sorted(param_map.items(), key=lambda kv: kv[0].name))


def tune_grid(data: DataFrame, model: Estimator, grid: list[dict], task: str, old_score: float,
              folds: int = FOLDS, parallelism: int = 4, texts: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Cross-validated score of every parameter map; the best map, or ``{}`` without a grid.

    ``texts`` are the maps' names in the result, else MLlib's own.
    """
    schema = "params string, score double, best boolean, improvement double"
    if not grid:
        return data.sparkSession.createDataFrame([("", old_score, True, 0.0)], schema), {}
    cached = _spread(data)
    fitted = CrossValidator(
        estimator=model, estimatorParamMaps=grid, evaluator=_evaluator(task), numFolds=folds, foldCol="fold",
        parallelism=parallelism, seed=SEED).fit(cached)
    cached.unpersist()
    best = max(range(len(grid)), key=lambda i: fitted.avgMetrics[i])
    rows = [(text, float(s), i == best, max(float(s) - old_score, 0.0))
            for i, (text, s) in enumerate(zip(texts or map(_param_text, grid), fitted.avgMetrics))]
    return data.sparkSession.createDataFrame(rows, schema), grid[best]


def tune_random(data: DataFrame, model: Estimator, grid: list[dict], task: str, old_score: float, draws: int,
                seed: int = SEED) -> tuple[DataFrame, dict]:
    """The same search over a seeded draw of the parameter maps."""
    return tune_grid(data, model, random.Random(seed).sample(grid, min(draws, len(grid))), task, old_score)


def tune_model(data: DataFrame, task: str, name: str, old_score: float, n_features: int, n_classes: int = 0,
               draws: int | None = None, folds: int = FOLDS) -> tuple[DataFrame, dict[str, str]]:
    """Grid search of a model by name, or over a seeded draw of its grid.

    Gives ``params, score, best, improvement`` with the parameters as text, and the best
    map, which ``registry.estimator`` reads; ``{}`` for a model with nothing to tune.
    """
    grid = registry.grid(task, name)
    if draws is not None:
        grid = random.Random(SEED).sample(grid, min(draws, len(grid)))
    sizes = registry.Sizes(data.count(), n_features, n_classes)
    base = registry.estimator(task, name, {}, sizes)
    maps = [registry.param_map(registry.find(task, name), base, params, sizes) for params in grid]
    scaled = unit_label(data)[0] if task == "regression" else data
    table, best = tune_grid(scaled, base, maps, task, old_score, folds, texts=[registry.as_text(p) for p in grid])
    return table, grid[maps.index(best)] if grid else {}


def unit_label(data: DataFrame) -> tuple[DataFrame, float, float]:
    """The label less its mean in units of its deviation, and both; gradient solvers need that, R² does not notice."""
    mean, std = data.agg(F.avg("label"), F.stddev_pop("label")).first()
    mean, std = float(mean or 0.0), float(std or 1.0)
    return data.withColumn("label", (F.col("label") - F.lit(mean)) / F.lit(std)), mean, std


def improvement(scores: DataFrame, new: str, old: str) -> DataFrame:
    gain = F.col(new) - F.col(old)
    return scores.withColumn("improvement", F.when(gain.isNotNull(), F.greatest(gain, F.lit(0.0))))


def avg_improvement(improvements: DataFrame) -> DataFrame:
    return improvements.agg(F.coalesce(F.avg("improvement"), F.lit(0.0)).alias("avg_improvement"),
                            F.count_if(F.col("improvement") > 0).alias("n_improved"))


def confusion_counts(predictions: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: list[str] | None = None) -> DataFrame:
    return predictions.groupBy(*(by or []), label, prediction).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction",
                           by: list[str] | None = None) -> DataFrame:
    """Accuracy; precision, recall and F1 weighted by class size, 0 where undefined.

    Works on the counts of (label, prediction): each count adds to the row of
    its label and to the row of its prediction.
    """
    by = by or []
    counts = confusion_counts(predictions, label, prediction, by)
    hit = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(label).cast("string").alias("class"), F.col("n").alias("actual"), zero.alias("predicted"),
                 hit.cast("bigint").alias("hits")),
        F.struct(F.col(prediction).cast("string").alias("class"), zero.alias("actual"), F.col("n").alias("predicted"),
                 zero.alias("hits")))
    classes = counts.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "actual"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("actual") + F.col("predicted")), F.lit(0.0))
    weight = F.sum("actual")
    return classes.groupBy(*by).agg(
        F.try_divide(F.sum("hits"), weight).alias("accuracy"),
        F.try_divide(F.sum(precision * F.col("actual")), weight).alias("precision"),
        F.try_divide(F.sum(recall * F.col("actual")), weight).alias("recall"),
        F.try_divide(F.sum(f1 * F.col("actual")), weight).alias("f1_score"))


def regression_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: list[str] | None = None) -> DataFrame:
    """R², mean squared error, its root and mean absolute error in one aggregate."""
    y, error = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction)
    found = predictions.groupBy(*(by or [])).agg(
        F.avg(error * error).alias("mean_squared_error"), F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.var_pop(y).alias("_var"))
    return found.select(
        *(by or []), (1 - F.try_divide("mean_squared_error", "_var")).alias("r2_score"), "mean_squared_error",
        F.sqrt("mean_squared_error").alias("root_mean_squared_error"), "mean_absolute_error")


def validate_holdout(data: DataFrame, model: Estimator, task: str, key: str, params: dict | None = None) -> DataFrame:
    """Fit on 80 %, predict the rest; metrics and the sizes of both parts as one row.

    A regression is fitted to the training label in units of its deviation and measured in the label's own.
    """
    marked = stratified_split(data, key, "label" if task == "classification" else None).persist()
    try:
        train, test = marked.where(~F.col("is_test")), marked.where("is_test")
        mean, std = 0.0, 1.0
        if task == "regression":
            train, mean, std = unit_label(train)
        predictions = (model.fit(train, params) if params else model.fit(train)).transform(test)
        if task == "regression":
            predictions = predictions.withColumn("prediction", F.col("prediction") * F.lit(std) + F.lit(mean))
        measure = classification_metrics if task == "classification" else regression_metrics
        sizes = marked.agg(F.count_if(~F.col("is_test")), F.count_if("is_test")).first()
        found = measure(predictions).select(
            "*", F.lit(sizes[0]).cast("bigint").alias("train_size"), F.lit(sizes[1]).cast("bigint").alias("test_size"))
        return data.sparkSession.createDataFrame(found.collect(), found.schema)  # one row; the parts can go
    finally:
        marked.unpersist()


def validate_model(data: DataFrame, task: str, name: str, params: dict[str, str], key: str, n_features: int,
                   n_classes: int = 0) -> DataFrame:
    """The hold-out metrics of a model by name with parameters as text."""
    model = registry.estimator(task, name, params, registry.Sizes(data.count(), n_features, n_classes))
    return validate_holdout(data, model, task, key).select(
        F.lit(name).alias("model_name"), F.lit(registry.as_text(params)).alias("params"), "*")


def avg_metric_by_name(metrics: DataFrame, column: str = "metrics") -> DataFrame:
    """Mean of every metric over the models; ``metrics`` maps names to values."""
    return metrics.select(F.explode(column).alias("metric", "value")).groupBy("metric").agg(
        F.avg("value").alias("avg_value"))


def model_score(metrics: Column) -> Column:
    """Accuracy, else R², else 0."""
    return F.coalesce(F.try_element_at(metrics, F.lit("accuracy")), F.try_element_at(metrics, F.lit("r2_score")), F.lit(0.0))


def best_model(metrics: DataFrame, path: str = "file_path", column: str = "metrics") -> DataFrame:
    """The model of highest score, the first path on ties."""
    scored = metrics.select(F.col(path), model_score(F.col(column)).alias("score"))
    return scored.agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col(path))).alias("best")).select(
        F.col(f"best.{path}").alias(path), (-F.col("best.neg")).alias("score"))


def model_counts(models: DataFrame, name: str = "model_name") -> DataFrame:
    return models.groupBy(name).agg(F.count(F.lit(1)).alias("n_models"))
