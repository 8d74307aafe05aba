"""Projections, filters, predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sondage import schema
from sondage.operators import catalog, clean, profile, search, stats, tasks
from sondage.operators.models import data_characteristics, task_type

from sondage.operators.text_index import TextIndex
from sondage.session import shared_path

from .fixtures import shape, sql_shape
from .registry import case, table


@case("column_roles", """
    SELECT * FROM (VALUES (0, 'l_orderkey', 'bigint', 'numeric'), (1, 'l_partkey', 'bigint', 'numeric'),
      (2, 'l_suppkey', 'bigint', 'numeric'), (3, 'l_linenumber', 'int', 'numeric'), (4, 'l_quantity', 'double', 'numeric'),
      (5, 'l_extendedprice', 'double', 'numeric'), (6, 'l_discount', 'double', 'numeric'), (7, 'l_tax', 'double', 'numeric'))
      v(position, "column", dtype, role)
    UNION ALL SELECT 8, 'l_returnflag', 'string', CASE WHEN COUNT(DISTINCT l_returnflag) = 2 THEN 'binary' ELSE 'categorical' END FROM lineitem
    UNION ALL SELECT 9, 'l_linestatus', 'string', CASE WHEN COUNT(DISTINCT l_linestatus) = 2 THEN 'binary' ELSE 'categorical' END FROM lineitem
    UNION ALL SELECT 10, 'l_shipdate', 'timestamp_ntz', 'datetime'""")
def column_roles(spark, sf_dir):
    return profile.column_roles(table(spark, sf_dir, "lineitem"))


@case("select_numeric", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_numeric(spark, sf_dir):
    return schema.select_numeric(table(spark, sf_dir, "customer"))


@case("select_categorical", "SELECT p_name, p_brand, p_type FROM part")
def select_categorical(spark, sf_dir):
    return schema.select_categorical(table(spark, sf_dir, "part"))


@case("split_features_target", "SELECT p_partkey, p_size, p_retailprice AS target FROM part")
def split_features_target(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    features, target = schema.split_features_target(df)
    return df.select(*features, F.col(target).alias("target"))


@case("sample_rows", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
           (SELECT COUNT(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderkey LIMIT 5""")
def sample_rows(spark, sf_dir):
    return profile.sample_rows(table(spark, sf_dir, "orders"), ["o_orderkey"])


_SAMPLED = ["event_id", "user_id", "amount", "kind", "rare", "parity", "one", "ts"]


@case("sample_values", f"""
    WITH g AS (SELECT * FROM {sql_shape('gappy')}),
    long AS ({" UNION ALL ".join(f"SELECT event_id, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM g" for c in _SAMPLED)})
    SELECT "column", CAST(place AS INT) AS place, value FROM (
      SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY event_id) AS place FROM long WHERE value IS NOT NULL)
    WHERE place <= 3""")
def sample_values(spark, sf_dir):
    return profile.sample_values(shape(spark, sf_dir, "gappy"), "event_id")


@case("drop_sparse_columns", f"SELECT event_id, user_id, amount, kind, parity, one, ts FROM {sql_shape('gappy')}")
def drop_sparse_columns(spark, sf_dir):
    return clean.drop_sparse_columns(shape(spark, sf_dir, "gappy"))


@case("complete_pairs", f"""
    SELECT COUNT(*) AS n_rows, COUNT(CASE WHEN amount IS NOT NULL AND kind IS NOT NULL THEN 1 END) AS n_complete,
           COUNT(CASE WHEN amount IS NOT NULL AND kind IS NOT NULL THEN 1 END) >= 3 AS testable FROM {sql_shape('gappy')}""")
def complete_pairs(spark, sf_dir):
    return clean.complete_pairs(shape(spark, sf_dir, "gappy"), "amount", "kind")


@case("group_size_filter", """
    SELECT 'c_acctbal' AS dependent_variable, 'c_mktsegment' AS independent_variable, c_mktsegment AS category,
           COUNT(c_acctbal) AS n, ROUND(AVG(c_acctbal), 4) AS mean, ROUND(VAR_SAMP(c_acctbal), 2) AS var
    FROM customer GROUP BY c_mktsegment HAVING COUNT(c_acctbal) > 1
    UNION ALL SELECT 'c_acctbal', 'c_name', c_name, COUNT(c_acctbal), ROUND(AVG(c_acctbal), 4), ROUND(VAR_SAMP(c_acctbal), 2)
    FROM customer GROUP BY c_name HAVING COUNT(c_acctbal) > 1""")
def group_size_filter(spark, sf_dir):
    moments = stats.group_moments(table(spark, sf_dir, "customer"), ["c_acctbal"], ["c_mktsegment", "c_name"])
    return stats.group_size_filter(moments).withColumns({"mean": F.round("mean", 4), "var": F.round("var", 2)})


_HIGH_SQL = """
    WITH d AS (SELECT l_quantity, l_quantity * 3 + l_linenumber AS scaled, l_extendedprice, l_tax FROM lineitem),
    p AS (SELECT 'l_quantity' a, 'scaled' b, corr(l_quantity, scaled) r FROM d
      UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice) FROM d
      UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM d
      UNION ALL SELECT 'scaled', 'l_extendedprice', corr(scaled, l_extendedprice) FROM d
      UNION ALL SELECT 'scaled', 'l_tax', corr(scaled, l_tax) FROM d
      UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM d)"""


def _correlated(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity", (F.col("l_quantity") * 3 + F.col("l_linenumber")).alias("scaled"), "l_extendedprice", "l_tax")


@case("high_corr_pairs", _HIGH_SQL + """
    SELECT a AS variable1, b AS variable2, ROUND(r, 6) AS correlation FROM p WHERE abs(r) > 0.8""")
def high_corr_pairs(spark, sf_dir):
    return stats.high_corr_pairs(_correlated(spark, sf_dir)).withColumn("correlation", F.round("correlation", 6))


@case("missing_only", f"""
    SELECT 'amount' AS "column", COUNT(*) FILTER (amount IS NULL) AS n_missing FROM {sql_shape('gappy')}
    UNION ALL SELECT 'kind', COUNT(*) FILTER (kind IS NULL) FROM {sql_shape('gappy')}
    UNION ALL SELECT 'rare', COUNT(*) FILTER (rare IS NULL) FROM {sql_shape('gappy')}""")
def missing_only(spark, sf_dir):
    return profile.missing_only(shape(spark, sf_dir, "gappy"))


@case("stage_not_failed", f"""
    SELECT run_id, stage, ts, status FROM {sql_shape('stage_results')} WHERE status IS DISTINCT FROM 'failed'""")
def stage_not_failed(spark, sf_dir):
    return catalog.stage_not_failed(shape(spark, sf_dir, "stage_results")).select("run_id", "stage", "ts", "status")


@case("text_contains_search", """
    SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'on the') ORDER BY doc_id LIMIT 10""")
def text_contains_search(spark, sf_dir):
    return search.text_contains_search(table(spark, sf_dir, "documents"), F.col("text"), "On The", 10, "doc_id").select("doc_id", "lang")


_QUERIES = ["On The", "th", "tion of the", "que", "É", "no such run of words"]


@case("text_contains_indexed", " UNION ALL ".join(
    f"SELECT '{q}' AS query, doc_id FROM documents WHERE contains(lower(text), lower('{q}'))" for q in _QUERIES))
def text_contains_indexed(spark, sf_dir):
    """Every document that holds a query, through the trigram index."""
    index = TextIndex.build(table(spark, sf_dir, "documents"), shared_path(spark, "text-index"), "doc_id", F.col("text"))
    found = [index.holding(q).select(F.lit(q).alias("query"), F.col("key").alias("doc_id")) for q in _QUERIES]
    return reduce(DataFrame.unionByName, found)


@case("execution_stats_filter", f"""
    SELECT agent_type, task_type, COUNT(*) AS total_executions, ROUND(AVG(duration), 6) AS average_duration
    FROM {sql_shape('metric_events')} WHERE contains(agent_type || '_' || task_type, '7') AND contains(agent_type || '_' || task_type, 'click')
    GROUP BY 1, 2""")
def execution_stats_filter(spark, sf_dir):
    found = tasks.execution_stats_filter(tasks.task_execution_stats(shape(spark, sf_dir, "metric_events")), "7", "click")
    return found.select("agent_type", "task_type", "total_executions", F.round("average_duration", 6).alias("average_duration"))


@case("capability_lookup", """
    SELECT user_id AS agent_id, COUNT(DISTINCT event_type) AS n_capabilities FROM events GROUP BY user_id
    HAVING COUNT(*) FILTER (event_type = 'purchase') > 0""")
def capability_lookup(spark, sf_dir):
    # An agent can do what it has done: the few distinct types of its events.
    agents = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("agent_id")).agg(
        F.collect_set("event_type").alias("capabilities"))
    return catalog.capability_lookup(agents, "purchase").select(
        "agent_id", F.size("capabilities").cast("bigint").alias("n_capabilities"))


_TASK_COLUMNS = "id, agent_id, task_type, priority, status, created_at, scheduled_for, started_at, completed_at, error"


def _active_and_history(spark, sf_dir):
    records = shape(spark, sf_dir, "tasks")
    active = F.col("status").isin("pending", "running")
    return records.where(active), records.where(~active)


@case("tasks_for_agent", f"SELECT {_TASK_COLUMNS} FROM {sql_shape('tasks')} WHERE agent_id = 7")
def tasks_for_agent(spark, sf_dir):
    return tasks.tasks_for_agent(*_active_and_history(spark, sf_dir), 7)


@case("task_by_id", f"SELECT {_TASK_COLUMNS} FROM {sql_shape('tasks')} WHERE id = 501")
def task_by_id(spark, sf_dir):
    return tasks.task_by_id(*_active_and_history(spark, sf_dir), 501)


@case("required_fields_valid", f"""
    SELECT 'owner' AS absent, COUNT(*) AS n_rows, COUNT(*) FILTER (amount IS NULL OR kind IS NULL) AS failing_rows, FALSE AS valid
    FROM {sql_shape('gappy')}""")
def required_fields_valid(spark, sf_dir):
    return profile.required_fields_valid(shape(spark, sf_dir, "gappy"), ["event_id", "amount", "kind", "owner"])


@case("task_type", """
    SELECT * FROM (
      SELECT 'c_mktsegment' AS target, 'classification' AS task_type
      UNION ALL SELECT 'p_retailprice', CASE WHEN COUNT(DISTINCT p_retailprice) <= 10 THEN 'classification' ELSE 'regression' END FROM part
      UNION ALL SELECT 'l_linenumber', CASE WHEN COUNT(DISTINCT l_linenumber) <= 10 THEN 'classification' ELSE 'regression' END FROM lineitem
      UNION ALL SELECT 'quality', CASE WHEN COUNT(DISTINCT quality) <= 10 THEN 'classification' ELSE 'regression' END FROM labels)""")
def task_type_of(spark, sf_dir):
    targets = {"c_mktsegment": "customer", "p_retailprice": "part", "l_linenumber": "lineitem", "quality": "labels"}
    rows = [(t, task_type(table(spark, sf_dir, name), t)) for t, name in targets.items()]
    return spark.createDataFrame(rows, "target string, task_type string")


@case("data_characteristics", _HIGH_SQL + """
    SELECT (SELECT COUNT(*) FROM d) AS total_samples, 0 AS missing_values, 4 AS total_features, 4 AS numeric_features,
           0 AS categorical_features, COUNT(*) AS high_corr_pairs FROM p WHERE abs(r) > 0.8""")
def data_characteristics_of(spark, sf_dir):
    return data_characteristics(_correlated(spark, sf_dir))
