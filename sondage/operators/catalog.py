"""Keyed tables: candidates, cache entries, stage results, knowledge records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The thirteen stages, in order.
STAGES = (
    "dataset_discovery", "data_acquisition", "data_quality", "documentation", "eda", "feature_engineering",
    "statistical_analysis", "model_architecture", "hyperparameter_optimization", "model_validation",
    "insight_synthesis", "visualization", "final_report",
)

# Seconds a record stays valid per collection; insights stay for good.
COLLECTION_TTL = {"projects": 3600, "models": 3600, "datasets": 7200}

CACHE_HOURS = 24


def latest_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the one of highest order; combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)


def stage_result_append(store: DataFrame, new: DataFrame) -> DataFrame:
    """New results of known stages added to the store; others are ignored."""
    return store.unionByName(new.where(F.col("stage").isin(*STAGES)), allowMissingColumns=True)


def stage_result_latest(store: DataFrame, run: str = "run_id", ts: str = "ts") -> DataFrame:
    """Newest result of every known stage of every run; ``{}`` where a stage has none."""
    known = store.where(F.col("stage").isin(*STAGES))
    newest = known.groupBy(run, "stage").agg(F.max_by("payload", ts).alias("payload"))
    runs = store.select(run).distinct().withColumn("stage", F.explode(F.array(*[F.lit(s) for s in STAGES])))
    return runs.join(newest, [run, "stage"], "left").withColumn("payload", F.coalesce("payload", F.lit("{}")))


def dataset_ref_add(refs: DataFrame, new: DataFrame, key: str = "ref") -> DataFrame:
    """References with the absent ones added once."""
    added = new.select(key).distinct().join(refs.select(key), key, "left_anti")
    return refs.select(key).unionByName(added)


def kb_get(store: DataFrame, as_of: Column, order: Column) -> DataFrame:
    """Newest record per (collection, key) that has not expired at ``as_of``."""
    ttl = F.lit(None).cast("bigint")
    for collection, seconds in COLLECTION_TTL.items():
        ttl = F.when(F.col("collection") == collection, F.lit(seconds).cast("bigint")).otherwise(ttl)
    newest = latest_per_key(store, ["collection", "key"], order)
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), as_of)
    return newest.where(ttl.isNull() | (age < ttl * 1_000_000))


def kb_summary(store: DataFrame) -> DataFrame:
    """Distinct keys per collection: keys are grouped first, so a hot collection spreads over tasks."""
    return store.groupBy("collection", "key").agg(F.lit(1).alias("one")).groupBy("collection").agg(
        F.count(F.lit(1)).alias("n_keys"))


def download_cache_key(url: Column, filename: Column) -> Column:
    return F.md5(F.concat_ws("_", url, filename))


def cache_valid(entries: DataFrame, as_of: Column, hours: int = CACHE_HOURS) -> DataFrame:
    """Entries younger than the limit."""
    return entries.where(F.timestamp_diff("MICROSECOND", F.col("ts"), as_of) < hours * 3_600_000_000)


def cache_expired(entries: DataFrame, as_of: Column, hours: int = CACHE_HOURS) -> DataFrame:
    """Entries older than the limit."""
    return entries.where(F.timestamp_diff("MICROSECOND", F.col("ts"), as_of) > hours * 3_600_000_000)


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("file_count"),
                       (F.coalesce(F.sum("size_bytes"), F.lit(0)) / 1048576).alias("total_size_mb"))


def best_per_dataset(candidates: DataFrame, key: Column, score: str, seq: str) -> DataFrame:
    """The record of highest score per dataset, the earliest on ties."""
    keyed = candidates.withColumn("_dataset", key)
    order = F.struct(F.coalesce(F.col(score), F.lit(0.0)).alias("s"), (-F.col(seq)).alias("q"))
    rest = F.struct(*[F.col(c) for c in candidates.columns])
    best = keyed.groupBy("_dataset").agg(F.max_by(rest, order).alias("_row"))
    return best.select("_row.*")


def unique_by_ref(results: DataFrame, ref: str, query_no: str, position: str) -> DataFrame:
    """First occurrence of each ref over several searches."""
    order = F.struct(F.col(query_no), F.col(position))
    rest = [c for c in results.columns if c != ref]
    first = results.groupBy(ref).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return first.select(ref, "_row.*").select(*results.columns)


def catalog_rollup(sections: DataFrame, key: str, section: str, value: str, order: str) -> DataFrame:
    """One map of sections per dataset; the latest value of a section wins.

    Sections are reduced to one value each before they are gathered, so a map
    holds at most one entry per section name.
    """
    latest = sections.groupBy(key, section).agg(F.max_by(value, order).alias(value))
    return latest.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(section, value)))).alias("sections"),
        F.count(F.lit(1)).alias("n_sections"))


def merge_synthesis(parts: DataFrame) -> DataFrame:
    """Merged items of ``(part_no, kind, key, is_list, item_no, item)`` rows, one row per item.

    Insights, recommendations and list-valued documentation are appended in part
    order; other documentation keeps the first part's value. Items stay rows,
    ordered by (part_no, item_no), so no key is gathered into one list.
    """
    appended = F.col("is_list") | (F.col("kind") != "documentation")
    lists = parts.where(appended)
    single = parts.where(~appended)
    rest = [c for c in parts.columns if c not in ("kind", "key")]
    first = single.groupBy("kind", "key").agg(
        F.min_by(F.struct(*rest), F.struct("part_no", "item_no")).alias("_row")).select("kind", "key", "_row.*")
    return lists.unionByName(first.select(*parts.columns))


def stage_not_failed(results: DataFrame) -> DataFrame:
    return results.where(~F.col("status").eqNullSafe("failed"))


def recent(df: DataFrame, ts: str, k: int = 5, tie: str | None = None) -> DataFrame:
    """The last k rows by time."""
    order = [F.desc(ts)] + ([F.desc(tie)] if tie else [])
    return df.orderBy(*order).limit(k)


def log_success_ratio(log: DataFrame) -> DataFrame:
    good = F.count_if(~F.contains(F.lower("message"), F.lit("failed")))
    return log.agg(good.alias("successful"), F.count(F.lit(1)).alias("total")).withColumn(
        "ratio", F.coalesce(F.try_divide("successful", "total"), F.lit(0.0)))


def stage_success_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("stage").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"))


def quality_score(results: DataFrame) -> DataFrame:
    """Share of successful files, 0 without files."""
    return results.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("status") == "success").alias("successful"),
    ).withColumn("quality_score", F.coalesce(F.try_divide("successful", "total_files"), F.lit(0.0)))


def capability_lookup(agents: DataFrame, capability: str) -> DataFrame:
    return agents.where(F.array_contains("capabilities", capability))
