"""Roll-ups of task, metric and gauge records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import duration_seconds

# Priority names and the scheduler's limits.
PRIORITY_NAMES = {1: "LOW", 2: "NORMAL", 3: "HIGH", 4: "CRITICAL"}
TASKS_PER_AGENT = 3
CONCURRENT_TASKS = 10


def tasks_for_agent(active: DataFrame, history: DataFrame, agent: object) -> DataFrame:
    return active.unionByName(history).where(F.col("agent_id") == agent)


def task_by_id(active: DataFrame, history: DataFrame, task: object) -> DataFrame:
    return active.unionByName(history).where(F.col("id") == task)


def task_statistics(history: DataFrame) -> DataFrame:
    """Totals, success rate, and mean seconds of the completed tasks."""
    done = F.col("status") == "completed"
    seconds = F.when(done, duration_seconds(F.col("started_at"), F.col("completed_at")))
    return history.agg(
        F.count(F.lit(1)).alias("total_tasks"), F.count_if(done).alias("completed_tasks"),
        F.count_if(F.col("status") == "failed").alias("failed_tasks"),
        F.coalesce(F.avg(seconds), F.lit(0.0)).alias("average_execution_time"),
    ).withColumn("success_rate", F.coalesce(F.try_divide("completed_tasks", "total_tasks"), F.lit(0.0)))


def priority_name(priority: Column) -> Column:
    pairs = [F.lit(x) for kv in PRIORITY_NAMES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), priority)


def queue_sizes(queued: DataFrame) -> DataFrame:
    """Queued tasks per priority, and their total."""
    named = queued.select(priority_name(F.col("priority").cast("int")).alias("priority"))
    sizes = named.rollup("priority").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.grouping("priority").alias("_total"))
    return sizes.select(F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("priority")).alias("priority"), "n_tasks")


def agent_load(tasks: DataFrame, limit: int = TASKS_PER_AGENT) -> DataFrame:
    """Running tasks per agent and whether it may take another."""
    return tasks.where("status = 'running'").groupBy("agent_id").agg(F.count(F.lit(1)).alias("running")).withColumn(
        "can_accept", F.col("running") < limit)


def dispatch_order(queued: DataFrame, running: DataFrame, limit: int = TASKS_PER_AGENT,
                   concurrent: int = CONCURRENT_TASKS) -> DataFrame:
    """Queued tasks that may start now, by priority, then age: those whose agents have room for
    them, until ``concurrent`` tasks are running.

    At most ``limit`` tasks of an agent can start, so the rank filter runs
    before the shuffle too and a busy agent's queue is never gathered.
    """
    order = Window.partitionBy("agent_id").orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id"))
    head = queued.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit)
    load = running.groupBy("agent_id").agg(F.count(F.lit(1)).alias("_running"))
    free = F.lit(limit) - F.coalesce(F.col("_running"), F.lit(0))
    ready = head.join(load, "agent_id", "left").where(F.col("_place") <= free).drop("_place", "_running")
    return ready.orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id")).limit(max(concurrent - running.count(), 0))


def due_tasks(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Tasks without a start time, or whose start time has come."""
    return tasks.where(F.col("scheduled_for").isNull() | (F.col("scheduled_for") <= as_of))


def task_execution_stats(events: DataFrame) -> DataFrame:
    """Runs, successes, success rate, mean and total seconds per (agent, task type)."""
    return events.groupBy("agent_type", "task_type").agg(
        F.count(F.lit(1)).alias("total_executions"), F.count_if("success").alias("successes"),
        F.avg("duration").alias("average_duration"), F.sum("duration").alias("total_duration"),
    ).withColumn("success_rate", F.col("successes") / F.col("total_executions"))


def execution_stats_filter(stats: DataFrame, agent: str | None = None, task: str | None = None) -> DataFrame:
    """Statistics whose ``agent_task`` key holds the given parts."""
    key = F.concat_ws("_", F.col("agent_type").cast("string"), F.col("task_type"))
    for part in (agent, task):
        if part:
            stats = stats.where(F.contains(key, F.lit(part)))
    return stats


def error_breakdown(errors: DataFrame) -> DataFrame:
    """Errors per (agent, type), with the total as a row of its own."""
    counted = errors.groupBy("agent_type", "error_type").agg(F.count(F.lit(1)).alias("n_errors"))
    total = counted.agg(F.coalesce(F.sum("n_errors"), F.lit(0)).cast("bigint").alias("n_errors"))
    kinds = counted.select(F.concat_ws("_", F.col("agent_type").cast("string"), "error_type").alias("error_key"), "n_errors")
    return kinds.unionByName(total.select(F.lit("total").alias("error_key"), "n_errors"))


def latest_gauges(gauges: DataFrame) -> DataFrame:
    return gauges.groupBy("key").agg(F.max_by("value", F.struct("ts", "id")).alias("value"))


def system_health(gauges: DataFrame) -> DataFrame:
    """Newest gauge values, split into active counts and resource use by their key."""
    newest = latest_gauges(gauges)
    active = F.contains("key", F.lit("active_"))
    resource = F.contains("key", F.lit("memory")) | F.contains("key", F.lit("cpu"))
    groups = F.array_compact(F.array(F.when(active, "active_agents"), F.when(resource, "resource_usage")))
    return newest.select(F.explode(groups).alias("section"), "key", "value")


def project_durations(projects: DataFrame) -> DataFrame:
    """Number, mean, shortest and longest completion time."""
    return projects.agg(F.count("duration").alias("n_projects"), F.avg("duration").alias("avg_duration"),
                        F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"))


def execution_summary(executions: DataFrame) -> DataFrame:
    """Runs, successes, rate, mean time and last run per agent."""
    last = F.max_by(F.struct("ts", "id", "success", "duration"), F.struct("ts", "id"))
    return executions.groupBy("agent_type").agg(
        F.count(F.lit(1)).alias("total_executions"), F.count_if("success").alias("successful_executions"),
        F.avg("duration").alias("average_execution_time"), last.alias("last"),
    ).select(
        "agent_type", "total_executions", "successful_executions",
        (F.col("successful_executions") / F.col("total_executions")).alias("success_rate"),
        "average_execution_time", F.col("last.ts").alias("last_ts"), F.col("last.id").alias("last_id"),
        F.col("last.success").alias("last_success"))


def model_usage_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("kind").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def metrics_export(events: DataFrame) -> DataFrame:
    """Long ``(metric, value)`` rows: total and success rate per task."""
    stats = task_execution_stats(events)
    key = F.concat_ws("_", F.lit("task"), F.col("agent_type").cast("string"), F.col("task_type"))
    return stats.select(F.inline(F.array(
        F.struct(F.concat(key, F.lit("_total")).alias("metric"),
                 F.col("total_executions").cast("double").alias("value")),
        F.struct(F.concat(key, F.lit("_success_rate")).alias("metric"), F.col("success_rate").alias("value")))))
