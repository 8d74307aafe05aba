"""Scans, sources, sinks and keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sondage.operators import catalog, tasks
from sondage.session import shared_path
from sondage.sources import files, stores

from .fixtures import STAGE_NAMES, shape, sql_shape
from .registry import case, table

_STAGES_SQL = ", ".join(f"('{s}')" for s in STAGE_NAMES[:13])
AS_OF = "TIMESTAMP '2024-01-15 00:00:00'"


def _as_of():
    return F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")


def _customer_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("c_custkey").cast("bigint")).alias("key_sum"),
                  F.round(F.sum(F.col("c_acctbal").cast("double")), 2).alias("balance"),
                  F.max(F.col("c_name").cast("string")).alias("last_name"))


_TOTALS_SQL = ("SELECT COUNT(*) AS n_rows, CAST(SUM(c_custkey) AS BIGINT) AS key_sum, ROUND(SUM(c_acctbal), 2) AS balance, "
               "MAX(c_name) AS last_name FROM customer")


@case("read_by_extension", f"""
    SELECT kind, 'success' AS status, t.* FROM (VALUES ('csv'), ('json'), ('parquet'), ('tsv')) k(kind), ({_TOTALS_SQL}) t
    UNION ALL SELECT 'missing', 'failed', NULL, NULL, NULL, NULL""")
def read_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "extensions")
    source = table(spark, sf_dir, "customer")
    source.write.option("header", True).csv(f"{folder}/customer.csv")
    source.write.option("header", True).option("sep", "\t").csv(f"{folder}/customer.tsv")
    source.write.json(f"{folder}/customer.json")
    source.write.parquet(f"{folder}/customer.parquet")
    kinds = {f"{folder}/customer.{k}": k for k in ("csv", "json", "parquet", "tsv")}
    kinds[f"{folder}/missing.parquet"] = "missing"
    tables, status = files.read_all(spark, list(kinds), _customer_totals)
    totals = stores.union_files(tables)
    names = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return status.join(totals, F.col("path") == F.col("table_id"), "left").select(
        F.element_at(names, F.col("path")).alias("kind"), "status", "n_rows", "key_sum", "balance", "last_name")


@case("read_grouped", """
    SELECT 'csv' AS ext, 'c_custkey,c_acctbal' AS shape, (SELECT COUNT(*) FROM customer) + 0 AS n_rows, 3 AS n_files FROM range(1)
    UNION ALL SELECT 'csv', 'c_custkey,c_name', COUNT(*), 2 FROM customer
    UNION ALL SELECT 'parquet', 'c_custkey int64, c_mktsegment string', COUNT(*), 2 FROM customer""")
def read_grouped(spark, sf_dir):
    """Seven files of three layouts: three reads."""
    folder, source = shared_path(spark, "grouped"), table(spark, sf_dir, "customer")
    dealt = lambda n: source.repartitionByRange(n, "c_custkey")
    dealt(3).select("c_custkey", "c_acctbal").write.option("header", True).csv(f"{folder}/a")
    dealt(2).select("c_custkey", "c_name").write.option("header", True).csv(f"{folder}/b/c")
    dealt(2).select("c_custkey", "c_mktsegment").write.parquet(f"{folder}/d")
    parts = [frame.agg(F.lit(ext).alias("ext"), F.lit(shape_).alias("shape"), F.count(F.lit(1)).alias("n_rows"),
                       F.count_distinct("table_id").cast("int").alias("n_files")) for ext, shape_, frame in files.read_grouped(spark, folder)]
    return reduce(DataFrame.unionByName, parts)


@case("read_sniff_delimiter", _TOTALS_SQL)
def read_sniff_delimiter(spark, sf_dir):
    path = shared_path(spark, "sniff") + "/customer.dat"
    table(spark, sf_dir, "customer").write.option("header", True).option("sep", ";").csv(path)
    return _customer_totals(files.read_table(spark, path))


@case("read_cleaned", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def read_cleaned(spark, sf_dir):
    path = stores.write_table(table(spark, sf_dir, "orders"), shared_path(spark, "cleaned"), "raw/orders.csv", "cleaned")
    return files.read_cleaned(spark, path).select("o_orderkey", "o_orderdate", "o_totalprice")


@case("write_table", "SELECT c_custkey, c_name, c_acctbal, 'customer_processed.csv' AS written FROM customer")
def write_table(spark, sf_dir):
    path = stores.write_table(table(spark, sf_dir, "customer"), shared_path(spark, "processed"), "customer.json",
                              "processed", fmt="csv")
    back = files.read_table(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return back.select("c_custkey", "c_name", "c_acctbal", F.lit(path.rsplit("/", 1)[-1]).alias("written"))


@case("file_manifest")
def file_manifest(spark, sf_dir):
    return files.file_manifest(spark, sf_dir, sniff=True)


_KIND_SQL = """
    CASE WHEN path LIKE '%.csv' THEN 'csv' WHEN lower(path) LIKE '%.xlsx' OR path LIKE '%.xls' THEN 'excel'
         WHEN path LIKE '%.json' THEN 'json' WHEN path LIKE '%.parquet' THEN 'parquet'
         WHEN path LIKE '%.txt' OR path LIKE '%.tsv' THEN 'text'
         WHEN path LIKE '%.zip' OR path LIKE '%.tar' OR path LIKE '%.gz' THEN 'archive'
         WHEN head LIKE 'PK%' THEN 'zip' WHEN head LIKE '{"%' THEN 'json' ELSE 'unknown' END"""


def _classified(spark, sf_dir):
    return shape(spark, sf_dir, "files").withColumn(
        "file_type", files.classify_file_type(F.col("path"), F.encode("head", "UTF-8")))


@case("classify_file_type", f"SELECT path, {_KIND_SQL} AS file_type FROM {sql_shape('files')}")
def classify_file_type(spark, sf_dir):
    return _classified(spark, sf_dir).select("path", "file_type")


@case("file_type_counts", f"SELECT {_KIND_SQL} AS file_type, COUNT(*) AS n_files FROM {sql_shape('files')} GROUP BY 1")
def file_type_counts(spark, sf_dir):
    return files.file_type_counts(_classified(spark, sf_dir))


@case("ingest_gate", f"""
    SELECT path, length FROM {sql_shape('files')}
    WHERE regexp_matches(lower(path), '\\.(csv|json|parquet|xlsx|xls)$') AND length / 1048576.0 <= 100""")
def ingest_gate(spark, sf_dir):
    return files.ingest_gate(shape(spark, sf_dir, "files")).select("path", "length")


@case("download_cache_key", "SELECT page_id, md5(url || '_' || page_id || '.html') AS cache_key FROM pages")
def download_cache_key(spark, sf_dir):
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    return table(spark, sf_dir, "pages").select("page_id", catalog.download_cache_key(F.col("url"), name).alias("cache_key"))


@case("cache_valid", f"SELECT cache_key, ts FROM {sql_shape('cache_entries')} WHERE {AS_OF} - ts < INTERVAL 24 HOURS")
def cache_valid(spark, sf_dir):
    return catalog.cache_valid(shape(spark, sf_dir, "cache_entries"), _as_of()).select("cache_key", "ts")


@case("cache_expired", f"SELECT cache_key, ts FROM {sql_shape('cache_entries')} WHERE ts < {AS_OF} - INTERVAL 24 HOURS")
def cache_expired(spark, sf_dir):
    return catalog.cache_expired(shape(spark, sf_dir, "cache_entries"), _as_of()).select("cache_key", "ts")


@case("cache_stats", f"""
    SELECT COUNT(*) AS file_count, ROUND(SUM(size_bytes) / 1048576.0, 6) AS total_size_mb FROM {sql_shape('cache_entries')}""")
def cache_stats(spark, sf_dir):
    return catalog.cache_stats(shape(spark, sf_dir, "cache_entries")).withColumn(
        "total_size_mb", F.round("total_size_mb", 6))


@case("write_results_json", f"""
    SELECT run_id, COUNT(*) AS n, MAX(original_path) AS last_path, MIN(status) AS first_status
    FROM {sql_shape('file_summaries')} GROUP BY run_id""")
def write_results_json(spark, sf_dir):
    nested = shape(spark, sf_dir, "file_summaries").select("run_id", F.struct("original_path", "status").alias("file"))
    path = stores.write_results_json(nested, shared_path(spark, "results"))
    back = spark.read.schema("run_id bigint, file struct<original_path string, status string>").json(path)
    return back.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("file.original_path").alias("last_path"),
                                      F.min("file.status").alias("first_status"))


@case("stage_result_append", f"""
    SELECT run_id, stage, ts, payload FROM {sql_shape('stage_results')}
    WHERE status IS DISTINCT FROM 'failed' OR stage IN (SELECT s FROM (VALUES {_STAGES_SQL}) v(s))""")
def stage_result_append(spark, sf_dir):
    results = shape(spark, sf_dir, "stage_results")
    failed = F.col("status").eqNullSafe("failed")
    return catalog.stage_result_append(results.where(~failed), results.where(failed)).select("run_id", "stage", "ts", "payload")


@case("stage_result_latest", f"""
    WITH r AS (SELECT * FROM {sql_shape('stage_results')}),
         best AS (SELECT run_id, stage, payload, row_number() OVER (PARTITION BY run_id, stage ORDER BY ts DESC) rn FROM r)
    SELECT u.run_id, v.s AS stage, COALESCE(b.payload, '{{}}') AS payload
    FROM (SELECT DISTINCT run_id FROM r) u CROSS JOIN (VALUES {_STAGES_SQL}) v(s)
    LEFT JOIN best b ON b.run_id = u.run_id AND b.stage = v.s AND b.rn = 1""")
def stage_result_latest(spark, sf_dir):
    return catalog.stage_result_latest(shape(spark, sf_dir, "stage_results"))


@case("pipeline_log_append", f"""
    SELECT agent, COUNT(*) AS n_rows, MAX(ts) AS last_ts FROM {sql_shape('log')} GROUP BY agent""")
def pipeline_log_append(spark, sf_dir):
    path = shared_path(spark, "log")
    log = shape(spark, sf_dir, "log")
    stores.append_rows(log.where("agent = 'error'"), path)
    stores.append_rows(log.where("agent <> 'error'"), path)
    return spark.read.parquet(path).groupBy("agent").agg(F.count(F.lit(1)).alias("n_rows"), F.max("ts").alias("last_ts"))


@case("dataset_ref_add", f"SELECT DISTINCT ref FROM {sql_shape('search_results')}")
def dataset_ref_add(spark, sf_dir):
    results = shape(spark, sf_dir, "search_results")
    known = results.where("query_no < 40").select("ref").distinct()
    return catalog.dataset_ref_add(known, results.where("query_no >= 30"))


@case("kb_upsert", f"""
    SELECT collection, key, ts, data FROM (
      SELECT *, row_number() OVER (PARTITION BY collection, key ORDER BY ts DESC, event_id DESC) AS rn
      FROM {sql_shape('knowledge')}) WHERE rn = 1""")
def kb_upsert(spark, sf_dir):
    path = shared_path(spark, "knowledge")
    records = shape(spark, sf_dir, "knowledge")
    stores.append_rows(records.where("event_id % 2 = 0"), path)
    stores.append_rows(records.where("event_id % 2 = 1"), path)
    stored = spark.read.parquet(path)
    return catalog.latest_per_key(stored, ["collection", "key"], F.struct("ts", "event_id")).select("collection", "key", "ts", "data")


_KB_AS_OF = "(SELECT max(ts) + INTERVAL 30 MINUTES FROM events)"


@case("kb_get", f"""
    SELECT collection, key, ts, data FROM (
      SELECT *, row_number() OVER (PARTITION BY collection, key ORDER BY ts DESC, event_id DESC) AS rn
      FROM {sql_shape('knowledge')})
    WHERE rn = 1 AND (collection = 'insights' OR {_KB_AS_OF} - ts <
          CASE collection WHEN 'datasets' THEN INTERVAL 7200 SECONDS ELSE INTERVAL 3600 SECONDS END)""")
def kb_get(spark, sf_dir):
    newest = table(spark, sf_dir, "events").agg(F.timestamp_add("MINUTE", F.lit(30), F.max("ts"))).first()[0]
    found = catalog.kb_get(shape(spark, sf_dir, "knowledge"), F.lit(newest).cast("timestamp_ntz"), F.struct("ts", "event_id"))
    return found.select("collection", "key", "ts", "data")


@case("kb_summary", f"SELECT collection, COUNT(DISTINCT key) AS n_keys FROM {sql_shape('knowledge')} GROUP BY 1")
def kb_summary(spark, sf_dir):
    return catalog.kb_summary(shape(spark, sf_dir, "knowledge"))


@case("metrics_export", f"""
    WITH s AS (SELECT agent_type, task_type, COUNT(*) AS n, AVG(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS rate
               FROM {sql_shape('metric_events')} GROUP BY 1, 2)
    SELECT 'task_' || agent_type || '_' || task_type || '_total' AS metric, CAST(n AS DOUBLE) AS value FROM s
    UNION ALL SELECT 'task_' || agent_type || '_' || task_type || '_success_rate', ROUND(rate, 6) FROM s""")
def metrics_export(spark, sf_dir):
    return tasks.metrics_export(shape(spark, sf_dir, "metric_events")).withColumn("value", F.round("value", 6))
