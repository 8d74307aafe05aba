"""Record shapes derived from the given tables, in SQL that both engines read.

``AFTER[t; s]`` stands for the time ``s`` seconds after ``t``, and ``DAY[t]`` for
a time's ISO date as text; each engine has its own function for them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .registry import table

# The thirteen stage names and two unknown ones.
STAGE_NAMES = (
    "dataset_discovery data_acquisition data_quality documentation eda feature_engineering statistical_analysis "
    "model_architecture hyperparameter_optimization model_validation insight_synthesis visualization final_report "
    "warm_up clean_up"
).split()


def pick(expression: str, values: list[str]) -> str:
    """CASE that picks a text by a number from 0."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expression} {arms} END"


SHAPES = {
    # A table with gaps: a number, a text, a mostly missing number, a constant and a date.
    "gappy": """
        SELECT event_id, user_id,
               CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS amount,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS kind,
               CASE WHEN event_id % 5 <> 0 THEN NULL ELSE value END AS rare,
               CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity,
               1.0 + 0 * value AS one, ts
        FROM {events}""",
    # Copies: a twentieth of the rows stands twice. Without the unique id, more rows are equal.
    "doubled": """
        SELECT event_id, user_id, event_type, value, ts FROM {events}
        UNION ALL
        SELECT event_id, user_id, event_type, value, ts FROM {events} WHERE event_id % 20 = 0""",
    # Everything the cleaner has to repair.
    "messy": """
        SELECT l_orderkey, l_linenumber, CAST(l_partkey AS STRING) AS part_text,
               CASE WHEN l_orderkey % 1000 = 1 THEN '1d' ELSE CAST(l_linenumber AS STRING) END AS bad_number,
               DAY[l_shipdate] AS ship_text,
               CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END AS quantity,
               CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_returnflag END AS flag,
               CASE WHEN l_partkey % 5 <> 0 THEN NULL ELSE l_tax END AS rare_tax
        FROM {lineitem}
        UNION ALL
        SELECT l_orderkey, l_linenumber, CAST(l_partkey AS STRING),
               CASE WHEN l_orderkey % 1000 = 1 THEN '1d' ELSE CAST(l_linenumber AS STRING) END,
               DAY[l_shipdate],
               CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END,
               CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_returnflag END,
               CASE WHEN l_partkey % 5 <> 0 THEN NULL ELSE l_tax END
        FROM {lineitem} WHERE l_orderkey % 20 = 0""",
    "tasks": """
        SELECT event_id AS id, user_id AS agent_id, event_type AS task_type,
               CAST(event_id % 4 + 1 AS INT) AS priority,
               CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 5 = 0 THEN 'pending'
                    WHEN event_id % 7 = 0 THEN 'running' ELSE 'completed' END AS status,
               ts AS created_at,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE AFTER[ts; event_id % 1000000] END AS scheduled_for,
               AFTER[ts; 1] AS started_at, AFTER[ts; 1 + value] AS completed_at,
               CASE WHEN event_type = 'error' THEN 'failure' END AS error
        FROM {events}""",
    "metric_events": """
        SELECT event_id AS id, user_id AS agent_type, event_type AS task_type, value AS duration,
               event_type <> 'error' AS success,
               CASE WHEN event_type = 'error' THEN CONCAT('type', CAST(event_id % 3 AS STRING)) END AS error_type, ts
        FROM {events}""",
    "gauges": """
        SELECT event_id AS id, ts, value,
               CONCAT(CASE event_id % 4 WHEN 0 THEN 'active_' WHEN 1 THEN 'memory_' WHEN 2 THEN 'cpu_' ELSE 'disk_' END,
                      CAST(user_id AS STRING)) AS key
        FROM {events}""",
    "stage_results": f"""
        SELECT user_id AS run_id, {pick('event_id % 15', STAGE_NAMES)} AS stage, ts,
               CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN NULL ELSE 'success' END AS status,
               props AS payload
        FROM {{events}}""",
    "log": """
        SELECT user_id AS run_id, event_type AS agent, ts, event_id,
               CASE WHEN event_type = 'error' THEN CONCAT('Agent Failed: ', props) ELSE 'done' END AS message
        FROM {events}""",
    "knowledge": f"""
        SELECT {pick('event_id % 4', ['projects', 'models', 'datasets', 'insights'])} AS collection,
               CONCAT('k', CAST(event_id % 100 AS STRING)) AS key, ts, props AS data, event_id
        FROM {{events}}""",
    "cache_entries": """
        SELECT CAST(event_id AS STRING) AS cache_key, CONCAT('http://host/', event_type) AS url,
               CONCAT(CAST(user_id AS STRING), '.csv') AS filename, ts,
               CAST(event_id * 37 AS BIGINT) AS size_bytes, event_type AS source_type
        FROM {events}""",
    "files": f"""
        SELECT doc_id, CONCAT('raw/', source, '/', CAST(doc_id AS STRING),
               {pick('doc_id % 13', ['.csv', '.XLSX', '.xls', '.json', '.parquet', '.txt', '.tsv', '.zip', '.tar',
                                     '.tar.gz', '.bin', '', '.dat'])}) AS path,
               n_chars * 100000 AS length,
               CASE doc_id % 3 WHEN 0 THEN 'PK12' WHEN 1 THEN '{{{{"a": 1' ELSE SUBSTRING(text, 1, 10) END AS head
        FROM {{documents}}""",
    "candidates": """
        SELECT doc_id, CONCAT(source, '/', CAST(doc_id AS STRING)) AS ref, text AS title,
               CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END AS description,
               lang, source, n_chars AS download_count, doc_id % 20 AS vote_count, doc_id % 11 AS usability_rating
        FROM {documents}""",
    # Several searches that return the same records at different places and scores.
    "search_results": """
        SELECT doc_id % 97 AS query_no, doc_id AS position, CONCAT(source, '/', lang) AS ref,
               (doc_id * 7919) % 1000 / 1000.0 AS relevance_score, text AS title
        FROM {documents}""",
    "file_summaries": """
        SELECT user_id AS run_id, event_id, CONCAT('file', CAST(event_id AS STRING), '.csv') AS original_path,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
               event_id AS original_rows, event_id - event_id % 10 AS cleaned_rows,
               event_id % 10 AS duplicates_removed, user_id AS missing_handled, event_id % 3 AS types_corrected
        FROM {events}""",
    # One row of facts per run.
    "facts": """
        SELECT user_id AS run_id, COUNT(*) AS total_files,
               SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed_cleanings,
               SUM(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) * 1.0 / COUNT(*) AS quality_score,
               SUM(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS significant_tests,
               SUM(CASE WHEN event_type = 'purchase' AND value > 50 THEN 1 ELSE 0 END) AS successful_validations,
               CASE WHEN user_id % 3 = 0 THEN NULL ELSE (user_id % 10) / 10.0 END AS avg_accuracy,
               (user_id % 7) / 7.0 AS avg_r2
        FROM {events} GROUP BY user_id""",
    # Fold scores of three models per table, some of them failed.
    "scores": """
        SELECT o_custkey AS table_id,
               CASE o_orderstatus WHEN 'F' THEN 'Random Forest' WHEN 'O' THEN 'Logistic Regression' ELSE 'SVM' END AS model, CAST(o_orderkey % 5 AS INT) AS fold,
               CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE (o_orderkey * 7919 % 1000) / 1000.0 END AS score,
               CASE WHEN o_orderkey % 50 = 0 THEN 'did not converge' END AS error
        FROM {orders}""",
    # Validated models: accuracy for two thirds of them, R² for the others, some with neither.
    "metrics": """
        SELECT CONCAT('data/', CAST(c_custkey AS STRING), '.csv') AS file_path, c_mktsegment AS model_name,
               CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey * 7919 % 997) / 1000.0 END AS accuracy,
               CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey * 104729 % 991) / 1000.0 END AS f1_score,
               CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN (c_custkey * 7907 % 983) / 1000.0 END AS r2_score
        FROM {customer}""",
    # Text replies: JSON, text with a score, fenced code, plain lines.
    "replies": r"""
        SELECT doc_id,
               CASE doc_id % 5
                 WHEN 0 THEN CONCAT('{{"score": 0.', LPAD(CAST(doc_id % 100 AS STRING), 2, '0'), ', "reasoning": "r', CAST(doc_id AS STRING),
                                    '", "confidence": 0.25, "recommendations": ["a', CAST(doc_id AS STRING), '", "b"]}}')
                 WHEN 1 THEN CONCAT('Relevance Score: 0.', CAST(doc_id % 10 AS STRING), ' because ', text)
                 WHEN 2 THEN CONCAT('Intro ', text, NL[], '```python', NL[], ' x = ', CAST(doc_id AS STRING), ' ', NL[], '```', NL[],
                                    'then', NL[], '```', NL[], 'y = 2', NL[], '```', NL[], ' end ')
                 WHEN 3 THEN CONCAT(' first line ', NL[], NL[], '   ', NL[], 'second ', CAST(doc_id AS STRING), NL[], ' third')
                 ELSE text END AS reply
        FROM {documents}""",
    # Parts of a synthesis to merge.
    "synthesis": """
        SELECT turn AS part_no, CASE conv_id % 3 WHEN 0 THEN 'insights' WHEN 1 THEN 'recommendations' ELSE 'documentation' END AS kind,
               CASE WHEN conv_id % 3 = 2 THEN CONCAT('doc', CAST(conv_id % 10 AS STRING)) ELSE '' END AS key,
               conv_id % 2 = 0 AS is_list, conv_id AS item_no, text AS item
        FROM {conversations}""",
    "sections": f"""
        SELECT CONCAT('d', CAST(event_id % 50 AS STRING)) AS dataset_id,
               {pick('event_id % 4', ['analysis', 'statistical_tests', 'feature_insights', 'quality_report'])} AS section,
               props AS payload, ts
        FROM {{events}}""",
}

_PLACE = re.compile(r"\{(\w+)\}")


def _engine_text(name: str, after: str, day: str, newline: str) -> str:
    text = SHAPES[name]
    text = re.sub(r"AFTER\[(.+?); (.+?)\]", after, text)
    text = re.sub(r"DAY\[(.+?)\]", day, text)
    return text.replace("NL[]", newline)


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived records as a DataFrame over the given tables."""
    text = _engine_text(
        name, r"timestampadd(MICROSECOND, CAST(round((\2) * 1000000) AS BIGINT), \1)",
        r"date_format(\1, 'yyyy-MM-dd')", "char(10)")
    inputs = {t: table(spark, sf_dir, t) for t in set(_PLACE.findall(text.replace("{{", "").replace("}}", "")))}
    return spark.sql(text, **inputs)


def sql_shape(name: str) -> str:
    """The same records as a DuckDB subquery."""
    text = _engine_text(
        name, r"(\1 + to_microseconds(CAST(round((\2) * 1000000) AS BIGINT)))", r"strftime(\1, '%Y-%m-%d')", "chr(10)")
    text = text.replace("{{", "\0").replace("}}", "\1")
    text = _PLACE.sub(r"\1", text)
    return "(" + text.replace("\0", "{").replace("\1", "}") + ")"
