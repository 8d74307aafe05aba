"""Findings, descriptions and chart series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sondage.operators import charts, insights, profile, stats
from sondage.operators.catalog import stage_success_counts

from .aggregates import rounded, with_metrics
from .fixtures import shape, sql_shape
from .registry import case, table
from .statistics import ALL_TESTS_SQL, GAPPY, LINEITEM, all_tests, each, pairs_sql

_FACTS = f"(SELECT *, quality_score::DOUBLE AS q FROM {sql_shape('facts')})"


def _facts(spark, sf_dir):
    facts = shape(spark, sf_dir, "facts")
    return facts.withColumns({"quality_score": F.col("quality_score").cast("double"), "avg_accuracy": F.col("avg_accuracy").cast("double"),
                              "avg_r2": F.col("avg_r2").cast("double")})


_FINDINGS_SQL = f"""
    SELECT run_id, 1 AS place, CASE WHEN q > 0.8 THEN 'High data quality achieved with minimal cleaning required'
      WHEN q > 0.5 THEN 'Moderate data quality with some cleaning issues resolved' ELSE 'Data quality issues identified requiring attention' END AS finding FROM {_FACTS}
    UNION ALL SELECT run_id, 2, 'Found ' || significant_tests || ' statistically significant relationships' FROM {_FACTS} WHERE significant_tests > 0
    UNION ALL SELECT run_id, 3, 'Successfully validated ' || successful_validations || ' models' FROM {_FACTS} WHERE successful_validations > 0
    UNION ALL SELECT run_id, 4, CASE WHEN avg_accuracy > 0.8 THEN 'High model accuracy achieved across validated models' ELSE 'Good model performance with high R² scores' END
      FROM {_FACTS} WHERE successful_validations > 0 AND (COALESCE(avg_accuracy, 0) > 0.8 OR avg_r2 > 0.7)"""
_ADVICE_SQL = f"""
    SELECT run_id, 1 AS place, 'Address data quality issues in failed cleaning operations' AS recommendation FROM {_FACTS} WHERE failed_cleanings > 0
    UNION ALL SELECT run_id, 2, 'Focus on variables with significant relationships for feature engineering' FROM {_FACTS} WHERE significant_tests > 0
    UNION ALL SELECT run_id, 3, 'Consider ensemble methods to improve model performance' FROM {_FACTS} WHERE successful_validations > 0
    UNION ALL SELECT run_id, 4, 'Implement cross-validation for more robust model evaluation' FROM {_FACTS} WHERE successful_validations > 0
    UNION ALL SELECT run_id, 5, 'Document all preprocessing steps for reproducibility' FROM {_FACTS}
    UNION ALL SELECT run_id, 6, 'Consider feature importance analysis for model interpretability' FROM {_FACTS}"""
_CONCLUSIONS_SQL = f"""
    SELECT run_id, TRUE AS research_question_addressed, q >= 0.5 AS data_suitable_for_analysis, successful_validations <> 0 AS models_performed_adequately,
           TRUE AS insights_generated, TRUE AS recommendations_provided, q >= 0.5 AND successful_validations <> 0 AS pipeline_success FROM {_FACTS}"""


@case("key_findings", _FINDINGS_SQL)
def key_findings(spark, sf_dir):
    return insights.key_findings(_facts(spark, sf_dir))


@case("recommendations", _ADVICE_SQL)
def recommendations(spark, sf_dir):
    return insights.recommendations(_facts(spark, sf_dir))


@case("conclusions", _CONCLUSIONS_SQL)
def conclusions(spark, sf_dir):
    return insights.conclusions(_facts(spark, sf_dir))


@case("key_issues", f"""
    SELECT run_id, event_id, 'Failed to clean ' || CASE WHEN event_id % 4 = 0 THEN 'unknown file' ELSE original_path END AS issue
    FROM {sql_shape('file_summaries')} WHERE status = 'failed'""")
def key_issues(spark, sf_dir):
    files = shape(spark, sf_dir, "file_summaries").withColumn(
        "original_path", F.when(F.col("event_id") % 4 != 0, F.col("original_path")))
    return insights.key_issues(files).select("run_id", "event_id", "issue")


def _name_rules(column: str, family: str) -> str:
    rules = [(["id"], "Unique identifier for the record"), (["date", "time"], "Date/time information"),
             (["price", "cost", "amount"], "Monetary value or price information"), (["name", "title"], "Name or title information"),
             (["email"], "Email address"), (["phone"], "Phone number"), (["address"], "Address information")]
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower('{column}'), '{p}')" for p in parts) + f" THEN '{s}'" for parts, s in rules)
    return f"CASE {arms} WHEN '{family}' = 'numeric' THEN 'Numeric value' WHEN '{family}' = 'string' THEN 'Text or categorical information' ELSE 'Data field' END"


_FAMILY = {"bigint": "numeric", "int": "numeric", "double": "numeric", "string": "string", "timestamp_ntz": "datetime"}


@case("describe_column", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{d}' AS dtype, COUNT(*) - COUNT({c}) AS n_missing, COUNT(DISTINCT {c}) AS n_distinct, "
    f"{_name_rules(c, _FAMILY[d])} AS description FROM {t}"
    for t, columns in {"lineitem": LINEITEM, "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
                                                      "p_size": "int", "p_retailprice": "double"}}.items()
    for i, (c, d) in enumerate(columns.items())))
def describe_column(spark, sf_dir):
    parts = [insights.document_columns(table(spark, sf_dir, t)) for t in ("lineitem", "part")]
    return reduce(DataFrame.unionByName, parts).drop("missing_pct")


@case("describe_table", f"""
    SELECT 'customer' AS table_id, 'This dataset contains ' || COUNT(*) || ' rows and 5 columns. It has 3 numeric columns including c_custkey, c_nationkey, c_acctbal. It has 2 categorical columns including c_name, c_mktsegment. The data types include bigint, double, int, string. ' AS description,
      'This dataset contains ' || COUNT(*) || ' records with 5 columns. It includes 3 numeric, 2 categorical, and 0 datetime columns. ' AS summary FROM customer
    UNION ALL SELECT 'lineitem', 'This dataset contains ' || COUNT(*) || ' rows and 11 columns. It has 8 numeric columns including l_orderkey, l_partkey, l_suppkey. It has 2 categorical columns including l_returnflag, l_linestatus. It has 1 datetime columns including l_shipdate. The data types include bigint, double, int, string, timestamp_ntz. ',
      'This dataset contains ' || COUNT(*) || ' records with 11 columns. It includes 8 numeric, 2 categorical, and 1 datetime columns. ' FROM lineitem
    UNION ALL SELECT 'gappy', 'This dataset contains ' || COUNT(*) || ' rows and 8 columns. It has 5 numeric columns including event_id, user_id, amount. It has 2 categorical columns including kind, parity. It has 1 datetime columns including ts. The dataset has ' ||
        SUM((amount IS NULL)::INT + (kind IS NULL)::INT + (rare IS NULL)::INT) || ' missing values across all columns. The data types include bigint, double, string, timestamp_ntz. ',
      'This dataset contains ' || COUNT(*) || ' records with 8 columns. It includes 5 numeric, 2 categorical, and 1 datetime columns. There are ' ||
        SUM((amount IS NULL)::INT + (kind IS NULL)::INT + (rare IS NULL)::INT) || ' missing values that may need attention. ' FROM {sql_shape('gappy')}""")
def describe_table(spark, sf_dir):
    sources = {"customer": table(spark, sf_dir, "customer"), "lineitem": table(spark, sf_dir, "lineitem"), "gappy": shape(spark, sf_dir, "gappy")}
    facts = reduce(DataFrame.unionByName, [insights.table_facts(df, name) for name, df in sources.items()])
    return insights.heuristic_summary(insights.describe_tables(facts)).select("table_id", "description", "summary")


@case("combine_summaries", f"""
    WITH s AS (SELECT run_id, event_id, status, 'File ' || original_path || ' has ' || cleaned_rows || ' rows.' AS summary FROM {sql_shape('file_summaries')})
    , p AS (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY event_id) - 1) // 1000 AS part FROM s WHERE status = 'success')
    SELECT run_id, part, COUNT(*) AS n_summaries, string_agg(summary, ' ' ORDER BY event_id) AS combined FROM p GROUP BY run_id, part
    UNION ALL SELECT run_id, 0, 0, 'No dataset summaries available.' FROM s GROUP BY run_id HAVING COUNT(*) FILTER (status = 'success') = 0""")
def combine_summaries(spark, sf_dir):
    files = shape(spark, sf_dir, "file_summaries")
    text = F.concat(F.lit("File "), "original_path", F.lit(" has "), F.col("cleaned_rows").cast("string"), F.lit(" rows."))
    return insights.combined_text(files.withColumn("summary", text), ["run_id"], "event_id")


@case("stage_summary_text", f"""
    WITH r AS (SELECT stage, COUNT(*) AS total, COUNT(*) FILTER (status = 'success') AS ok, COUNT(*) FILTER (status IS NOT NULL) AS items FROM {sql_shape('stage_results')} GROUP BY stage)
    SELECT stage, CASE stage WHEN 'eda' THEN 'EDA Analysis Summary:' || chr(10) || '- Files analyzed: ' || ok || '/' || total || chr(10) || '- Visualizations created: ' || items
      WHEN 'statistical_analysis' THEN 'Statistical Analysis Summary:' || chr(10) || '- Files analyzed: ' || ok || '/' || total || chr(10) || '- Total tests performed: ' || items
      WHEN 'model_architecture' THEN 'Model Architecture Design Summary:' || chr(10) || '- Files analyzed: ' || ok || '/' || total || chr(10) || '- Models recommended: ' || items
      WHEN 'hyperparameter_optimization' THEN 'Hyperparameter Optimization Summary:' || chr(10) || '- Models optimized: ' || ok || '/' || total || chr(10) || '- Models with improvement: ' || items
      WHEN 'model_validation' THEN 'Model Validation Summary:' || chr(10) || '- Models validated: ' || ok || '/' || total || chr(10) || '- Metrics averaged: ' || items
      WHEN 'visualization' THEN 'Visualization Summary:' || chr(10) || '- Visualizations created: ' || ok || '/' || total || chr(10) || '- Charts created: ' || items END AS summary
    FROM r WHERE stage IN ('eda', 'statistical_analysis', 'model_architecture', 'hyperparameter_optimization', 'model_validation', 'visualization')""")
def stage_summary_text(spark, sf_dir):
    rollup = stage_success_counts(shape(spark, sf_dir, "stage_results")).withColumn("items", F.col("successful") + F.col("failed"))
    return insights.stage_summary_text(rollup).select("stage", "summary")


def _histogram_sql(column: str, bins: int, source: str) -> str:
    return f"""
    SELECT '{column}' AS "column", CAST(LEAST(floor(({column} - lo) / (hi - lo) * {bins}), {bins - 1}) AS INT) AS bin, COUNT(*) AS n
    FROM {source}, (SELECT MIN({column})::DOUBLE AS lo, MAX({column})::DOUBLE AS hi FROM {source}) WHERE {column} IS NOT NULL GROUP BY 2"""


@case("histogram", " UNION ALL ".join(_histogram_sql(c, 30, "lineitem") for c in list(LINEITEM)[:4])
      + " UNION ALL " + _histogram_sql("l_extendedprice", 10, "lineitem")
      + " UNION ALL " + _histogram_sql("rare", 30, sql_shape("gappy")))
def histogram(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    scores = charts.histogram(df, ["l_extendedprice"], charts.SCORE_BINS)
    gaps = charts.histogram(shape(spark, sf_dir, "gappy"), ["rare"])
    return charts.histogram(df).unionByName(scores).unionByName(gaps).select("column", "bin", "n")


def _box_sql(column: str, source: str) -> str:
    return f"""
    SELECT '{column}' AS "column", ROUND(q1, 6) AS q1, ROUND(q2, 6) AS median, ROUND(q3, 6) AS q3,
           MIN({column}) FILTER ({column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::DOUBLE AS whisker_low,
           MAX({column}) FILTER ({column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::DOUBLE AS whisker_high,
           COUNT(*) FILTER ({column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM {source}, (SELECT quantile_cont({column}::DOUBLE, 0.25) AS q1, quantile_cont({column}::DOUBLE, 0.5) AS q2, quantile_cont({column}::DOUBLE, 0.75) AS q3 FROM {source})
    GROUP BY q1, q2, q3"""


@case("box_stats", " UNION ALL ".join(_box_sql(c, sql_shape("gappy")) for c in ("event_id", "user_id", "amount", "rare")))
def box_stats(spark, sf_dir):
    return rounded(charts.box_stats(shape(spark, sf_dir, "gappy")), "q1", "median", "q3")


_HEAT = ["event_id", "user_id", "amount", "rare", "one"]


@case("heatmap_cells", f"""
    WITH half AS ({pairs_sql(_HEAT, sql_shape('gappy'))})
    SELECT variable1, variable2, CASE WHEN isfinite(r) THEN ROUND(r, 6) END AS correlation FROM half
    UNION ALL SELECT variable2, variable1, CASE WHEN isfinite(r) THEN ROUND(r, 6) END FROM half
    UNION ALL {each(_HEAT, f"SELECT '$C', '$C', CASE WHEN MIN($C) < MAX($C) THEN 1.0::DOUBLE END FROM {sql_shape('gappy')}")}""")
def heatmap_cells(spark, sf_dir):
    return rounded(stats.correlation_matrix(shape(spark, sf_dir, "gappy")), "correlation")


@case("missing_bars", "SELECT * FROM (" + each(GAPPY, f"SELECT '$C' AS \"column\", COUNT(*) - COUNT($C) AS n_missing FROM {sql_shape('gappy')}")
      + ") WHERE n_missing > 0")
def missing_bars(spark, sf_dir):
    return profile.missing_only(shape(spark, sf_dir, "gappy"))


_LABEL = "array_to_string(list_transform(string_split(stage, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"


@case("stage_status_bars", f"""
    SELECT stage, {_LABEL} AS label, CASE WHEN status IS NULL OR status = 'failed' THEN 0 ELSE 1 END AS bar, COUNT(*) AS n FROM {sql_shape('stage_results')} GROUP BY 1, 2, 3""")
def stage_status_bars(spark, sf_dir):
    return charts.stage_status_bars(shape(spark, sf_dir, "stage_results")).groupBy("stage", "label", "bar").agg(F.count(F.lit(1)).alias("n"))


@case("success_failed_share", f"""
    WITH c AS (SELECT COUNT(*) FILTER (status = 'success') AS good, COUNT(*) FILTER (status = 'failed') AS bad FROM {sql_shape('file_summaries')})
    SELECT 'Successful' AS label, good AS n, ROUND(good / (good + bad), 6) AS share FROM c UNION ALL SELECT 'Failed', bad, ROUND(bad / (good + bad), 6) FROM c""")
def success_failed_share(spark, sf_dir):
    return rounded(charts.success_failed_share(shape(spark, sf_dir, "file_summaries")), "share")


@case("score_per_model", f"""
    SELECT file_path, ROUND(COALESCE(accuracy, r2_score, 0)::DOUBLE, 6) AS score, ROUND(COALESCE(accuracy, 0)::DOUBLE, 6) AS accuracy, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall,
           ROUND(COALESCE(f1_score, 0)::DOUBLE, 6) AS f1_score FROM {sql_shape('metrics')}""")
def score_per_model(spark, sf_dir):
    return rounded(charts.score_per_model(with_metrics(spark, sf_dir)), "score", "accuracy", "f1_score")


@case("significance_share", f"""{ALL_TESTS_SQL},
    c AS (SELECT COUNT(*) FILTER (significant) AS yes, COUNT(*) AS total FROM everything)
    SELECT 'Significant' AS label, yes AS n, ROUND(yes / total, 6) AS share FROM c UNION ALL SELECT 'Non-significant', total - yes, ROUND((total - yes) / total, 6) FROM c""")
def significance_share(spark, sf_dir):
    return rounded(charts.significance_share(all_tests(spark, sf_dir)), "share")


@case("finding_counts", f"""
    SELECT 'Key Findings' AS category, COUNT(*) AS n FROM ({_FINDINGS_SQL}) UNION ALL SELECT 'Recommendations', COUNT(*) FROM ({_ADVICE_SQL})
    """ + "".join(f" UNION ALL SELECT '{f}', COUNT(*) FILTER ({f}) FROM ({_CONCLUSIONS_SQL})" for f in (
        "research_question_addressed", "data_suitable_for_analysis", "models_performed_adequately", "insights_generated", "recommendations_provided", "pipeline_success")))
def finding_counts(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return charts.finding_counts(insights.key_findings(facts), insights.recommendations(facts), insights.conclusions(facts))


@case("run_report", f"""
    WITH f AS (SELECT * FROM {sql_shape('file_summaries')}), c AS (SELECT * FROM {sql_shape('candidates')}), m AS (SELECT * FROM {sql_shape('metrics')}),
    d AS (SELECT row_number() OVER (ORDER BY download_count DESC, doc_id) AS place, title FROM c),
    s AS (SELECT row_number() OVER (ORDER BY COALESCE(accuracy, r2_score, 0) DESC, file_path) AS place, file_path FROM m),
    k AS (SELECT row_number() OVER (ORDER BY run_id, place) AS place, finding FROM ({_FINDINGS_SQL}))
    SELECT 'files' AS section, 0 AS place, COUNT(*)::VARCHAR AS value FROM f
    UNION ALL SELECT 'datasets', place, title FROM d WHERE place <= 3
    UNION ALL SELECT 'models', place, file_path FROM s WHERE place <= 3
    UNION ALL SELECT 'findings', place, finding FROM k WHERE place <= 5""")
def run_report(spark, sf_dir):
    def first(df, k, *order):
        """The first rows with their places; the order is total, and k rows are few."""
        from pyspark.sql import Window

        return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))

    scored = charts.score_per_model(with_metrics(spark, sf_dir))
    findings = insights.key_findings(_facts(spark, sf_dir))
    return insights.run_report({
        "files": (shape(spark, sf_dir, "file_summaries"), "", None),
        "datasets": (first(shape(spark, sf_dir, "candidates"), 3, F.desc("download_count"), "doc_id"), "title", 3),
        "models": (first(scored, 3, F.desc("score"), "file_path"), "file_path", 3),
        "findings": (first(findings, 5, "run_id", "place"), "finding", 5),
    })
