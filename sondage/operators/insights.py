"""Threshold rules over a facts table with one row per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import describe_column
from ..ordering import Lookup, dense_index, lookup_join
from ..schema import columns_of, present, schema_table
from .profile import column_profile

SUMMARIES_PER_PART = 1000


def _listed(facts: DataFrame, key: str, sentences: list[Column], name: str) -> DataFrame:
    """One row per sentence that applies, in rule order."""
    numbered = F.filter(F.array(*[F.struct(F.lit(i).alias("place"), s.alias(name)) for i, s in enumerate(sentences, 1)]),
                        lambda s: s[name].isNotNull())
    return facts.select(key, F.inline(numbered))


def key_findings(facts: DataFrame, key: str = "run_id") -> DataFrame:
    # Thresholds and sentences of the findings.
    quality = F.coalesce(F.col("quality_score"), F.lit(0.0))
    validated = F.coalesce(F.col("successful_validations"), F.lit(0))
    significant = F.coalesce(F.col("significant_tests"), F.lit(0))
    high_accuracy = F.coalesce(F.col("avg_accuracy") > 0.8, F.lit(False))
    good_fit = F.coalesce(F.col("avg_r2") > 0.7, F.lit(False))
    return _listed(facts, key, [
        F.when(quality > 0.8, "High data quality achieved with minimal cleaning required")
        .when(quality > 0.5, "Moderate data quality with some cleaning issues resolved")
        .otherwise("Data quality issues identified requiring attention"),
        F.when(significant > 0, F.format_string("Found %d statistically significant relationships", significant)),
        F.when(validated > 0, F.format_string("Successfully validated %d models", validated)),
        F.when((validated > 0) & high_accuracy, "High model accuracy achieved across validated models")
        .when((validated > 0) & good_fit, "Good model performance with high R² scores"),
    ], "finding")


def recommendations(facts: DataFrame, key: str = "run_id") -> DataFrame:
    # Sentences of the recommendations.
    failed = F.coalesce(F.col("failed_cleanings"), F.lit(0)) > 0
    significant = F.coalesce(F.col("significant_tests"), F.lit(0)) > 0
    validated = F.coalesce(F.col("successful_validations"), F.lit(0)) > 0
    return _listed(facts, key, [
        F.when(failed, "Address data quality issues in failed cleaning operations"),
        F.when(significant, "Focus on variables with significant relationships for feature engineering"),
        F.when(validated, "Consider ensemble methods to improve model performance"),
        F.when(validated, "Implement cross-validation for more robust model evaluation"),
        F.lit("Document all preprocessing steps for reproducibility"),
        F.lit("Consider feature importance analysis for model interpretability"),
    ], "recommendation")


def conclusions(facts: DataFrame, key: str = "run_id") -> DataFrame:
    """Six flags per run; poor data or no validated model turns success off."""
    suitable = F.coalesce(F.col("quality_score"), F.lit(0.0)) >= 0.5
    adequate = F.coalesce(F.col("successful_validations"), F.lit(0)) != 0
    return facts.select(
        key, F.lit(True).alias("research_question_addressed"), suitable.alias("data_suitable_for_analysis"),
        adequate.alias("models_performed_adequately"), F.lit(True).alias("insights_generated"),
        F.lit(True).alias("recommendations_provided"), (suitable & adequate).alias("pipeline_success"))


def key_issues(files: DataFrame, path: str = "original_path") -> DataFrame:
    """One message per failed file."""
    failed = files.where("status = 'failed'")
    return failed.select("*", F.concat(
        F.lit("Failed to clean "), F.coalesce(F.col(path), F.lit("unknown file"))).alias("issue"))


def top_findings(tests: DataFrame, order: list[Column], k: int = 5) -> DataFrame:
    """The first k significant tests in the given order, those of them that have a sentence."""
    first = tests.where("significant").orderBy(*order).limit(k)
    missing = F.lit("N/A")
    sentence = (
        F.when(F.col("test_type") == "pearson_correlation", F.concat(
            F.lit("Strong correlation ("), F.format_string("%.3f", F.coalesce("correlation", F.lit(0.0))),
            F.lit(") between "), F.coalesce("variable1", missing), F.lit(" and "), F.coalesce("variable2", missing)))
        .when(F.col("test_type") == "t_test", F.concat(
            F.lit("Significant difference in "), F.coalesce("dependent_variable", missing), F.lit(" across "),
            F.coalesce("independent_variable", missing), F.lit(" groups")))
    )
    return first.select(sentence.alias("finding")).where("finding is not null")


def document_columns(df: DataFrame) -> DataFrame:
    """Profile and description of every column."""
    families = schema_table(df).select("position", "column", "family")
    profiled = column_profile(df).join(F.broadcast(families), "column")
    return profiled.select("position", "column", "dtype", "n_missing", "missing_pct", "n_distinct",
                           describe_column(F.col("column"), F.col("family")).alias("description"))


def table_facts(df: DataFrame, table_id: str) -> DataFrame:
    """One row of facts about a table, as the description sentences need them."""
    missing = F.lit(0).cast("bigint")
    for c in df.columns:
        missing = missing + F.count_if(present(df, c).isNull())

    def names(*families: str) -> Column:
        return F.array(*[F.lit(c) for c in columns_of(df, *families)]).cast("array<string>")

    return df.agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("n_missing")).select(
        F.lit(table_id).alias("table_id"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "n_missing",
        names("numeric").alias("numeric_columns"), names("string").alias("categorical_columns"),
        names("datetime").alias("datetime_columns"),
        F.array(*[F.lit(t) for _, t in df.dtypes]).alias("dtypes"))


def describe_tables(facts: DataFrame) -> DataFrame:
    """Description sentence of each profiled table.

    ``facts`` has n_rows, n_columns, numeric / categorical / datetime name
    lists, n_missing and the list of types.
    """
    def part(names: str, label: str, shown: Column) -> Column:
        return F.when(F.size(names) > 0, F.concat(
            F.lit("It has "), F.size(names).cast("string"), F.lit(f" {label} columns including "),
            F.concat_ws(", ", shown), F.lit(". "))).otherwise("")

    text = F.concat(
        F.lit("This dataset contains "), F.col("n_rows").cast("string"), F.lit(" rows and "),
        F.col("n_columns").cast("string"), F.lit(" columns. "),
        part("numeric_columns", "numeric", F.slice("numeric_columns", 1, 3)),
        part("categorical_columns", "categorical", F.slice("categorical_columns", 1, 3)),
        part("datetime_columns", "datetime", F.col("datetime_columns")),
        F.when(F.col("n_missing") > 0, F.concat(
            F.lit("The dataset has "), F.col("n_missing").cast("string"),
            F.lit(" missing values across all columns. "))).otherwise(""),
        F.lit("The data types include "), F.concat_ws(", ", F.array_sort(F.array_distinct("dtypes"))), F.lit(". "))
    return facts.withColumn("description", text)


def heuristic_summary(facts: DataFrame) -> DataFrame:
    """The shorter summary: counts per family and missing values."""
    text = F.concat(
        F.lit("This dataset contains "), F.col("n_rows").cast("string"), F.lit(" records with "),
        F.col("n_columns").cast("string"), F.lit(" columns. It includes "),
        F.size("numeric_columns").cast("string"), F.lit(" numeric, "),
        F.size("categorical_columns").cast("string"), F.lit(" categorical, and "),
        F.size("datetime_columns").cast("string"), F.lit(" datetime columns. "),
        F.when(F.col("n_missing") > 0, F.concat(
            F.lit("There are "), F.col("n_missing").cast("string"),
            F.lit(" missing values that may need attention. "))).otherwise(""))
    return facts.withColumn("summary", text)


def combine_summaries(summaries: DataFrame, keys: list[str], order: str, text: str = "summary") -> DataFrame:
    """The run's text as rows ``keys, position, summary``: the summaries of its successful tables in order.

    A run without any has one row, a fixed sentence. ``order`` must be unique within a run. The rows keep one
    shape for a run of any number of tables; ``combined_text`` joins them.
    """
    return _placed_summaries(summaries, keys, order, text).select("run.*", "position", "summary")


def combined_text(summaries: DataFrame, keys: list[str], order: str, text: str = "summary") -> DataFrame:
    """The same summaries joined by a space, as rows ``keys, part, n_summaries, combined``.

    A text comes in parts of up to a thousand summaries, numbered from 0: most runs have one part, and a run of
    very many tables is never gathered in one task. The fixed sentence counts no summary.
    """
    placed = _placed_summaries(summaries, keys, order, text)
    parts = placed.groupBy("run", F.floor(F.col("position") / SUMMARIES_PER_PART).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("position", "summary"))).alias("held"), F.sum("found").alias("n_summaries"))
    return parts.select("run.*", "part", "n_summaries", F.concat_ws(" ", F.col("held.summary")).alias("combined"))


def _placed_summaries(summaries: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """``run, position, summary, found``: 1 for a summary, 0 for the sentence of a run without any."""
    good = (F.col("status") == "success") & F.col(text).isNotNull()
    run = F.struct(*[F.col(k) for k in keys])
    marked = summaries.select(run.alias("run"), F.col(order).alias("order"), F.when(good, F.col(text)).alias("text"))
    placed = dense_index(marked.where("text is not null"), [F.col("run"), F.col("order")], "place")
    starts = placed.groupBy("run").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    sizes = starts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    begun = lookup_join(placed, Lookup(starts, *sizes), F.col("run"), "run", ["start"])
    listed = begun.select("run", (F.col("place") - F.col("start")).alias("position"), F.col("text").alias("summary"), F.lit(1).alias("found"))
    none = marked.groupBy("run").agg(F.count("text").alias("n")).where("n = 0").select(
        "run", F.lit(0).cast("bigint").alias("position"), F.lit("No dataset summaries available.").alias("summary"), F.lit(0).alias("found"))
    return listed.unionByName(none)


def stage_summary_text(rollup: DataFrame) -> DataFrame:
    """One block of lines per stage from its roll-up row (files, successes, items)."""
    # The lines of each stage's summary.
    lines = {
        "eda": ("EDA Analysis Summary:", "Files analyzed", "Visualizations created"),
        "statistical_analysis": ("Statistical Analysis Summary:", "Files analyzed", "Total tests performed"),
        "model_architecture": ("Model Architecture Design Summary:", "Files analyzed", "Models recommended"),
        "hyperparameter_optimization": ("Hyperparameter Optimization Summary:", "Models optimized",
                                        "Models with improvement"),
        "model_validation": ("Model Validation Summary:", "Models validated", "Metrics averaged"),
        "visualization": ("Visualization Summary:", "Visualizations created", "Charts created"),
    }
    title = F.create_map(*[F.lit(x) for s, v in lines.items() for x in (s, v[0])])
    first = F.create_map(*[F.lit(x) for s, v in lines.items() for x in (s, v[1])])
    second = F.create_map(*[F.lit(x) for s, v in lines.items() for x in (s, v[2])])
    stage = F.col("stage")
    text = F.concat(
        F.try_element_at(title, stage), F.lit("\n- "), F.try_element_at(first, stage), F.lit(": "),
        F.col("successful").cast("string"), F.lit("/"), F.col("total").cast("string"),
        F.lit("\n- "), F.try_element_at(second, stage), F.lit(": "), F.col("items").cast("string"))
    return rollup.where(stage.isin(*lines)).withColumn("summary", text)


def run_report(sections: dict[str, tuple[DataFrame, str, int | None]]) -> DataFrame:
    """``(section, place, value)`` rows of a report.

    Each section is a table with ``place`` and a text column; a limit keeps the
    first rows by place, no limit keeps the count of rows instead.
    """
    parts = []
    for section, (table, column, limit) in sections.items():
        if limit is None:
            part = table.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
                F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("place"), "value")
        else:
            part = table.orderBy("place").limit(limit).select(
                F.lit(section).alias("section"), F.col("place").cast("bigint").alias("place"),
                F.col(column).cast("string").alias("value"))
        parts.append(part)
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
