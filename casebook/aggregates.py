"""Roll-ups of results, tasks, metrics and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.operators import catalog, clean, models, tasks

from .fixtures import shape, sql_shape
from .registry import case, table


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def with_metrics(spark, sf_dir):
    """Validated models with their metrics as a map; absent metrics have no entry."""
    flat = shape(spark, sf_dir, "metrics")
    entries = F.array_compact(F.array(*[
        F.when(F.col(m).isNotNull(), F.struct(F.lit(m), F.col(m).cast("double"))) for m in ("accuracy", "f1_score", "r2_score")]))
    return flat.select("file_path", "model_name", F.map_from_entries(entries).alias("metrics"))


@case("quality_rollup", f"""
    SELECT COUNT(*) AS total_files, COUNT(*) FILTER (status = 'success') AS successful_files,
           CAST(SUM(original_rows) FILTER (status = 'success') AS BIGINT) AS total_original_rows,
           CAST(SUM(cleaned_rows) FILTER (status = 'success') AS BIGINT) AS total_cleaned_rows,
           CAST(SUM(duplicates_removed) FILTER (status = 'success') AS BIGINT) AS total_duplicates_removed,
           CAST(SUM(missing_handled) FILTER (status = 'success') AS BIGINT) AS total_missing_handled,
           CAST(SUM(types_corrected) FILTER (status = 'success') AS BIGINT) AS total_type_fixes,
           ROUND(SUM(original_rows - cleaned_rows) FILTER (status = 'success') * 100.0 / SUM(original_rows) FILTER (status = 'success'), 6) AS reduction_pct
    FROM {sql_shape('file_summaries')}""")
def quality_rollup(spark, sf_dir):
    return rounded(clean.quality_rollup(shape(spark, sf_dir, "file_summaries")), "reduction_pct")


@case("stage_success_counts", f"""
    SELECT stage, COUNT(*) AS total, COUNT(*) FILTER (status = 'success') AS successful, COUNT(*) FILTER (status = 'failed') AS failed
    FROM {sql_shape('stage_results')} GROUP BY stage""")
def stage_success_counts(spark, sf_dir):
    return catalog.stage_success_counts(shape(spark, sf_dir, "stage_results"))


@case("quality_score", f"""
    SELECT COUNT(*) AS total_files, COUNT(*) FILTER (status = 'success') AS successful,
           ROUND(COUNT(*) FILTER (status = 'success') / COUNT(*), 6) AS quality_score FROM {sql_shape('file_summaries')}""")
def quality_score(spark, sf_dir):
    return rounded(catalog.quality_score(shape(spark, sf_dir, "file_summaries")), "quality_score")


_LONG_METRICS = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS v FROM {sql_shape('metrics')} WHERE {m} IS NOT NULL"
                                   for m in ("accuracy", "f1_score", "r2_score"))


@case("avg_metric_by_name", f"SELECT metric, ROUND(AVG(v), 6) AS avg_value FROM ({_LONG_METRICS}) GROUP BY metric")
def avg_metric_by_name(spark, sf_dir):
    return rounded(models.avg_metric_by_name(with_metrics(spark, sf_dir)), "avg_value")


@case("best_model", f"""
    SELECT file_path, ROUND(COALESCE(accuracy, r2_score, 0)::DOUBLE, 6) AS score FROM {sql_shape('metrics')}
    ORDER BY COALESCE(accuracy, r2_score, 0) DESC, file_path LIMIT 1""")
def best_model(spark, sf_dir):
    return rounded(models.best_model(with_metrics(spark, sf_dir)), "score")


def _tuned(spark, sf_dir):
    means = shape(spark, sf_dir, "scores").groupBy("table_id").agg(
        F.max("score").cast("double").alias("best"), F.min("score").cast("double").alias("least"))
    # Some tables got worse: their new score is half the old one.
    return means.select("table_id", F.when(F.col("table_id") % 2 == 0, F.col("best")).otherwise(F.col("least") / 2).alias("new_score"),
                        F.col("least").alias("old_score"))


_TUNED_SQL = f"""(SELECT table_id, CASE WHEN table_id % 2 = 0 THEN b ELSE m / 2 END AS new_score, m AS old_score FROM
    (SELECT table_id, MAX(score)::DOUBLE AS b, MIN(score)::DOUBLE AS m FROM {sql_shape('scores')} GROUP BY table_id))"""


@case("improvement", f"SELECT table_id, ROUND(GREATEST(new_score - old_score, 0), 10) AS improvement FROM {_TUNED_SQL}")
def improvement(spark, sf_dir):
    found = models.improvement(_tuned(spark, sf_dir), "new_score", "old_score")
    return rounded(found, "improvement", places=10).select("table_id", "improvement")


@case("avg_improvement", f"""
    SELECT ROUND(AVG(GREATEST(new_score - old_score, 0)), 6) AS avg_improvement,
           COUNT(*) FILTER (new_score > old_score) AS n_improved FROM {_TUNED_SQL}""")
def avg_improvement(spark, sf_dir):
    return rounded(models.avg_improvement(models.improvement(_tuned(spark, sf_dir), "new_score", "old_score")), "avg_improvement")


@case("model_counts", f"SELECT model_name, COUNT(*) AS n_models FROM {sql_shape('metrics')} GROUP BY 1")
def model_counts(spark, sf_dir):
    return models.model_counts(shape(spark, sf_dir, "metrics"))


_CLASS_SQL = """
    WITH p AS (SELECT l_returnflag AS label, CASE WHEN l_quantity < 20 THEN l_returnflag WHEN l_quantity < 40 THEN 'N' ELSE 'X' END AS prediction FROM lineitem),
    c AS (SELECT cls, COUNT(*) FILTER (label = cls) AS actual, COUNT(*) FILTER (prediction = cls) AS predicted,
                 COUNT(*) FILTER (label = cls AND prediction = cls) AS hits
          FROM p, (SELECT DISTINCT label AS cls FROM p UNION SELECT DISTINCT prediction FROM p) GROUP BY cls)"""


def _predicted(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("label"),
        F.when(F.col("l_quantity") < 20, F.col("l_returnflag")).when(F.col("l_quantity") < 40, "N").otherwise("X").alias("prediction"))


@case("classification_metrics", _CLASS_SQL + """
    SELECT ROUND(SUM(hits) / SUM(actual), 6) AS accuracy,
           ROUND(SUM(actual * CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END) / SUM(actual), 6) AS precision,
           ROUND(SUM(actual * CASE WHEN actual = 0 THEN 0 ELSE hits / actual END) / SUM(actual), 6) AS recall,
           ROUND(SUM(actual * CASE WHEN actual + predicted = 0 THEN 0 ELSE 2.0::DOUBLE * hits / (actual + predicted) END) / SUM(actual), 6) AS f1_score FROM c""")
def classification_metrics(spark, sf_dir):
    return rounded(models.classification_metrics(_predicted(spark, sf_dir)), "accuracy", "precision", "recall", "f1_score")


@case("confusion_counts", _CLASS_SQL + " SELECT label, prediction, COUNT(*) AS n FROM p GROUP BY 1, 2")
def confusion_counts(spark, sf_dir):
    return models.confusion_counts(_predicted(spark, sf_dir))


@case("regression_metrics", """
    WITH p AS (SELECT l_quantity AS y, l_extendedprice / 2000 + l_discount AS z FROM lineitem)
    SELECT ROUND(1 - AVG((y - z) ** 2) / VAR_POP(y), 6) AS r2_score, ROUND(AVG((y - z) ** 2), 6) AS mean_squared_error,
           ROUND(SQRT(AVG((y - z) ** 2)), 6) AS root_mean_squared_error, ROUND(AVG(ABS(y - z)), 6) AS mean_absolute_error FROM p""")
def regression_metrics(spark, sf_dir):
    predicted = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("label"), (F.col("l_extendedprice") / 2000 + F.col("l_discount")).alias("prediction"))
    return rounded(models.regression_metrics(predicted), "r2_score", "mean_squared_error", "root_mean_squared_error", "mean_absolute_error")


_STATS_SQL = f"""(SELECT table_id, model, AVG(score)::DOUBLE AS mean_score, STDDEV_POP(score)::DOUBLE AS std_score, COUNT(score) AS folds, MAX(error) AS error
    FROM {sql_shape('scores')} GROUP BY table_id, model)"""


@case("cv_score_stats", f"""
    SELECT table_id, model, ROUND(mean_score, 6) AS mean_score, ROUND(std_score, 6) AS std_score, folds, error FROM {_STATS_SQL}""")
def cv_score_stats(spark, sf_dir):
    return rounded(models.cv_score_stats(shape(spark, sf_dir, "scores"), ["table_id", "model"])
                   .withColumn("mean_score", F.col("mean_score").cast("double")), "mean_score", "std_score")


@case("recommend_model", f"""
    SELECT table_id, model AS model_name, 'classification' AS task_type, ROUND(mean_score, 6) AS cv_score, ROUND(std_score, 6) AS cv_std,
           CASE model WHEN 'Random Forest' THEN 'RandomForestClassifier' WHEN 'SVM' THEN 'SVC' ELSE 'LogisticRegression' END AS model_type FROM (
      SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY ROUND(mean_score, 9) DESC NULLS LAST, model) AS rn FROM {_STATS_SQL}) WHERE rn = 1""")
def recommend_model(spark, sf_dir):
    # Scores are compared at nine places, so that the order of summation decides nothing.
    stats = models.cv_score_stats(shape(spark, sf_dir, "scores"), ["table_id", "model"]).withColumn(
        "mean_score", F.round(F.col("mean_score").cast("double"), 9))
    best = models.recommend_model(stats, "classification", ["table_id"])
    return rounded(best.select("table_id", "model_name", "task_type", "cv_score", "cv_std",
                               F.col("params")["model_type"].alias("model_type")), "cv_score", "cv_std")


@case("task_statistics", f"""
    WITH h AS (SELECT * FROM {sql_shape('tasks')} WHERE status IN ('completed', 'failed'))
    SELECT COUNT(*) AS total_tasks, COUNT(*) FILTER (status = 'completed') AS completed_tasks, COUNT(*) FILTER (status = 'failed') AS failed_tasks,
           ROUND(COUNT(*) FILTER (status = 'completed') / COUNT(*), 6) AS success_rate,
           ROUND(AVG(epoch_us(completed_at) - epoch_us(started_at)) FILTER (status = 'completed') / 1e6, 6) AS average_execution_time FROM h""")
def task_statistics(spark, sf_dir):
    history = shape(spark, sf_dir, "tasks").where(F.col("status").isin("completed", "failed"))
    return rounded(tasks.task_statistics(history), "success_rate", "average_execution_time")


_PRIORITY = "CASE priority WHEN 1 THEN 'LOW' WHEN 2 THEN 'NORMAL' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END"


@case("queue_sizes", f"""
    SELECT COALESCE({_PRIORITY}, 'x') AS priority, COUNT(*) AS n_tasks FROM {sql_shape('tasks')} WHERE status = 'pending' GROUP BY 1
    UNION ALL SELECT 'TOTAL', COUNT(*) FROM {sql_shape('tasks')} WHERE status = 'pending'""")
def queue_sizes(spark, sf_dir):
    return tasks.queue_sizes(shape(spark, sf_dir, "tasks").where("status = 'pending'"))


@case("agent_load", f"""
    SELECT agent_id, COUNT(*) AS running, COUNT(*) < 3 AS can_accept FROM {sql_shape('tasks')} WHERE status = 'running' GROUP BY 1""")
def agent_load(spark, sf_dir):
    return tasks.agent_load(shape(spark, sf_dir, "tasks"))


@case("task_execution_stats", f"""
    SELECT agent_type, task_type, COUNT(*) AS total_executions, COUNT(*) FILTER (success) AS successes, ROUND(AVG(duration), 6) AS average_duration,
           ROUND(SUM(duration), 6) AS total_duration, ROUND(COUNT(*) FILTER (success) / COUNT(*), 6) AS success_rate
    FROM {sql_shape('metric_events')} GROUP BY 1, 2""")
def task_execution_stats(spark, sf_dir):
    return rounded(tasks.task_execution_stats(shape(spark, sf_dir, "metric_events")), "average_duration", "total_duration", "success_rate")


_ERRORS_SQL = f"(SELECT * FROM {sql_shape('metric_events')} WHERE error_type IS NOT NULL)"


@case("error_breakdown", f"""
    SELECT agent_type || '_' || error_type AS error_key, COUNT(*) AS n_errors FROM {_ERRORS_SQL} GROUP BY 1
    UNION ALL SELECT 'total', COUNT(*) FROM {_ERRORS_SQL}""")
def error_breakdown(spark, sf_dir):
    return tasks.error_breakdown(shape(spark, sf_dir, "metric_events").where("error_type IS NOT NULL"))


@case("system_health", f"""
    WITH newest AS (SELECT key, arg_max(value, ts) AS value FROM {sql_shape('gauges')} GROUP BY key)
    SELECT 'active_agents' AS section, key, value FROM newest WHERE contains(key, 'active_')
    UNION ALL SELECT 'resource_usage', key, value FROM newest WHERE contains(key, 'memory') OR contains(key, 'cpu')""")
def system_health(spark, sf_dir):
    return tasks.system_health(shape(spark, sf_dir, "gauges"))


@case("project_durations", f"""
    SELECT COUNT(d) AS n_projects, ROUND(AVG(d), 6) AS avg_duration, MIN(d) AS min_duration, MAX(d) AS max_duration
    FROM (SELECT CASE WHEN success THEN duration END AS d FROM {sql_shape('metric_events')})""")
def project_durations(spark, sf_dir):
    projects = shape(spark, sf_dir, "metric_events").select(F.when(F.col("success"), F.col("duration")).alias("duration"))
    return rounded(tasks.project_durations(projects), "avg_duration")


@case("execution_summary", f"""
    SELECT agent_type, COUNT(*) AS total_executions, COUNT(*) FILTER (success) AS successful_executions,
           ROUND(COUNT(*) FILTER (success) / COUNT(*), 6) AS success_rate, ROUND(AVG(duration), 6) AS average_execution_time,
           MAX(ts) AS last_ts, arg_max(id, ts) AS last_id, arg_max(success, ts) AS last_success FROM {sql_shape('metric_events')} GROUP BY 1""")
def execution_summary(spark, sf_dir):
    return rounded(tasks.execution_summary(shape(spark, sf_dir, "metric_events")), "success_rate", "average_execution_time")


@case("model_usage_stats", f"""
    SELECT task_type AS kind, COUNT(*) AS calls, COUNT(error) AS errors FROM
      (SELECT task_type, CASE WHEN duration > 100 THEN 'timeout' END AS error FROM {sql_shape('metric_events')}) GROUP BY 1""")
def model_usage_stats(spark, sf_dir):
    calls = shape(spark, sf_dir, "metric_events").select(
        F.col("task_type").alias("kind"), F.when(F.col("duration") > 100, "timeout").alias("error"))
    return tasks.model_usage_stats(calls)


@case("log_success_ratio", f"""
    SELECT COUNT(*) FILTER (NOT contains(lower(message), 'failed')) AS successful, COUNT(*) AS total,
           ROUND(COUNT(*) FILTER (NOT contains(lower(message), 'failed')) / COUNT(*), 6) AS ratio FROM {sql_shape('log')}""")
def log_success_ratio(spark, sf_dir):
    return rounded(catalog.log_success_ratio(shape(spark, sf_dir, "log")), "ratio")


@case("catalog_rollup", f"""
    SELECT dataset_id, COUNT(*) AS n_sections, MAX(p) FILTER (section = 'analysis') AS analysis, MAX(p) FILTER (section = 'statistical_tests') AS statistical_tests,
           MAX(p) FILTER (section = 'feature_insights') AS feature_insights, MAX(p) FILTER (section = 'quality_report') AS quality_report
    FROM (SELECT dataset_id, section, arg_max(payload, ts) AS p FROM {sql_shape('sections')} GROUP BY 1, 2) GROUP BY 1""")
def catalog_rollup(spark, sf_dir):
    rolled = catalog.catalog_rollup(shape(spark, sf_dir, "sections"), "dataset_id", "section", "payload", "ts")
    names = ["analysis", "statistical_tests", "feature_insights", "quality_report"]
    return rolled.select("dataset_id", "n_sections", *[F.try_element_at("sections", F.lit(n)).alias(n) for n in names])


@case("union_files", """
    SELECT 'customer' AS table_id, c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL::DOUBLE AS price FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier
    UNION ALL SELECT 'part', p_partkey, p_name, NULL, p_retailprice FROM part""")
def union_files(spark, sf_dir):
    from sondage.sources.stores import union_files as union

    return union({
        "customer": table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS balance"),
        "supplier": table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance"),
        "part": table(spark, sf_dir, "part").selectExpr("p_partkey AS key", "p_name AS name", "p_retailprice AS price"),
    })


@case("merge_synthesis", f"""
    WITH s AS (SELECT * FROM {sql_shape('synthesis')})
    SELECT part_no, kind, key, item_no, item FROM s WHERE is_list OR kind <> 'documentation'
    UNION ALL SELECT part_no, kind, key, item_no, item FROM (
      SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY part_no, item_no) AS rn FROM s WHERE NOT is_list AND kind = 'documentation') WHERE rn = 1""")
def merge_synthesis(spark, sf_dir):
    return catalog.merge_synthesis(shape(spark, sf_dir, "synthesis")).select("part_no", "kind", "key", "item_no", "item")


@case("ordered_distinct", """
    SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'p': list_position(w, x), 'x': x})), lambda s: s.x), '|') AS words
    FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def ordered_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", F.array_distinct(F.split("text", " "))).alias("words"))
