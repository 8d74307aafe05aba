"""The whole analysis of one table as a chain of DataFrames.

Each stage is a plain function; its outcome is one row (run, stage, time,
status, payload). A stage that fails is recorded and the next one runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import charts, clean, features, insights, models, profile, stats
from ..schema import columns_of, numeric_columns
from ..session import stored
from ..sources import stores

STAGE_SCHEMA = "run_id string, stage string, ts timestamp, status string, payload string"


class Analysis:
    """One run: the tables that stages hand to one another, and their outcomes."""

    def __init__(self, df: DataFrame, run_id: str, key: str, target: str, out: str | None = None,
                 compare: Callable[[DataFrame, str, int, int], DataFrame] | None = None, draws: int | None = None):
        self.source, self.run_id, self.key, self.target, self.out = df, run_id, key, target, out
        self.compare, self.draws = compare or default_comparison, draws
        self.tables: dict[str, DataFrame] = {}
        self.facts: dict[str, object] = {}
        self.rows: list[tuple] = []

    def run(self) -> DataFrame:
        """Run every stage and return ``(run_id, stage, ts, status, payload)``."""
        for name in ("data_quality", "documentation", "eda", "feature_engineering", "statistical_analysis",
                     "model_architecture", "hyperparameter_optimization", "model_validation", "insight_synthesis",
                     "visualization", "final_report"):
            try:
                status, payload = "success", getattr(self, name)()
            except Exception as error:  # recorded; later stages still run
                status, payload = "failed", {"error": f"{type(error).__name__}: {error}"}
            self.rows.append((self.run_id, name, datetime.now(timezone.utc), status, json.dumps(payload, default=str)))
        results = self.source.sparkSession.createDataFrame(self.rows, STAGE_SCHEMA)
        if self.out:
            for name, table in self.tables.items():
                stores.write_table(table, self.out, self.run_id, name)
            stores.append_rows(results, f"{self.out}/stage_results.parquet")
        return results

    def data_quality(self) -> dict:
        rows = self.source.count()
        cleaned, plan = clean.clean_table(self.source)
        self.tables["cleaned"] = cleaned
        return {"original_rows": rows, "cleaned_rows": plan.rows_after_dedup,
                "duplicates_removed": rows - plan.rows_after_dedup, "missing_handled": sum(plan.missing.values()),
                "types_corrected": len(plan.casts), "dropped": plan.dropped}

    def documentation(self) -> dict:
        self.tables["columns"] = insights.document_columns(self.tables["cleaned"])
        facts = insights.describe_tables(insights.table_facts(self.tables["cleaned"], self.run_id))
        return {"description": facts.first()["description"]}

    def eda(self) -> dict:
        table = self.tables["cleaned"]
        self.tables["describe"] = profile.numeric_describe(table)
        self.tables["correlations"] = stats.correlation_matrix(table)
        self.tables["top_values"] = profile.top_values(table)
        return {"numeric_columns": len(numeric_columns(table)), "string_columns": len(columns_of(table, "string"))}

    def feature_engineering(self) -> dict:
        """Transform the inputs; the key and the target keep their own values."""
        table = self.tables["cleaned"]
        renamed = table.select(*[c for c in table.columns if c not in (self.key, self.target)],
                               F.struct(self.key, self.target).alias("_kept"))
        made, plan = features.transform_features(renamed)
        self.tables["processed"] = made.select("_kept.*", *[c for c in made.columns if c != "_kept"])
        return {"numeric": plan.numeric, "binary": plan.binary, "categorical": plan.categorical,
                "new_features": sorted(plan.lineage)}

    def statistical_analysis(self) -> dict:
        table = self.tables["cleaned"].drop(self.key)
        # A row per pair of columns, read by several stages: written once.
        tests = stored(stats.union_tests(stats.pearson_test(table), stats.spearman_test(table), stats.anova_oneway(table),
                                         stats.t_test_ind(table)), "tests")
        self.tables["tests"] = tests
        summary = stats.stat_summary(tests).first().asDict()
        self.facts.update(significant_tests=summary["significant_tests"])
        return summary

    def _model_data(self) -> tuple[DataFrame, str, int, int]:
        table = self.tables["processed"]
        task = models.task_type(table, self.target)
        inputs = [c for c in numeric_columns(table) if c not in (self.key, self.target)]
        data = models.prepare(table, self.target, inputs, task, [self.key])
        classes = data.select("label").distinct().count() if task == "classification" else 0
        return data, task, len(inputs), classes

    def model_architecture(self) -> dict:
        data, task, n_features, n_classes = self._model_data()
        scores = self.compare(data, task, n_features, n_classes)
        self.tables["scores"] = scores
        best = models.recommend_model(models.cv_score_stats(scores), task).first()
        self.facts["chosen"] = (best["model_name"], best["cv_score"], dict(best["params"] or {}))
        return {"task_type": task, "model_name": best["model_name"], "cv_score": best["cv_score"], "cv_std": best["cv_std"],
                "recommended_params": best["params"]}

    def _chosen(self) -> tuple[str, float, dict[str, str]]:
        if "chosen" not in self.facts:
            raise RuntimeError("no model was recommended")
        return self.facts["chosen"]

    def hyperparameter_optimization(self) -> dict:
        """Grid search of the recommended model; the best parameters go on as text."""
        data, task, n_features, n_classes = self._model_data()
        name, score, _ = self._chosen()
        tuned, best = models.tune_model(data, task, name, score or 0.0, n_features, n_classes, self.draws)
        self.tables["tuning"] = tuned
        self.facts["tuned"] = best
        row = tuned.where("best").first()
        return {"model_name": name, "original_score": score, "optimized_score": row["score"],
                "performance_improvement": row["improvement"], "optimized_params": best}

    def model_validation(self) -> dict:
        """The recommended model with its tuned parameters, or the recommended ones where tuning gave none."""
        data, task, n_features, n_classes = self._model_data()
        name, _, recommended = self._chosen()
        params = self.facts.get("tuned") or recommended
        metrics = models.validate_model(data, task, name, params, self.key, n_features, n_classes).first().asDict()
        self.facts.update(successful_validations=1, avg_accuracy=metrics.get("accuracy"), avg_r2=metrics.get("r2_score"))
        numbers = {k: float(v) for k, v in metrics.items() if isinstance(v, (int, float))}
        self.tables["metrics"] = self.source.sparkSession.createDataFrame(
            [(self.run_id, name, numbers)], "file_path string, model_name string, metrics map<string,double>")
        return metrics

    def _facts(self) -> DataFrame:
        quality = [r for r in self.rows if r[1] == "data_quality"]
        good = sum(r[3] == "success" for r in quality)
        record = (self.run_id, good / max(len(quality), 1), len(quality) - good, self.facts.get("significant_tests", 0),
                  self.facts.get("successful_validations", 0), self.facts.get("avg_accuracy"), self.facts.get("avg_r2"))
        return self.source.sparkSession.createDataFrame([record], (
            "run_id string, quality_score double, failed_cleanings bigint, significant_tests bigint, "
            "successful_validations bigint, avg_accuracy double, avg_r2 double"))

    def insight_synthesis(self) -> dict:
        facts = self._facts()
        self.tables["findings"] = insights.key_findings(facts)
        self.tables["recommendations"] = insights.recommendations(facts)
        self.tables["conclusions"] = insights.conclusions(facts)
        return self.tables["conclusions"].first().asDict()

    def _stages(self) -> DataFrame:
        return self.source.sparkSession.createDataFrame(self.rows, STAGE_SCHEMA)

    def visualization(self) -> dict:
        """Every series that the tables so far allow; a failed stage costs its own series only."""
        table = self.tables["cleaned"]
        made = {
            "histogram": lambda: charts.histogram(table), "boxes": lambda: charts.box_stats(table),
            "missing_bars": lambda: profile.missing_only(self.source),
            "stage_status_bars": lambda: charts.stage_status_bars(self._stages()),
            "success_failed_share": lambda: charts.success_failed_share(self._stages()),
            "significance_share": lambda: charts.significance_share(self.tables["tests"]),
            "score_per_model": lambda: charts.score_per_model(self.tables["metrics"]),
            "finding_counts": lambda: charts.finding_counts(
                self.tables["findings"], self.tables["recommendations"], self.tables["conclusions"]),
        }
        needs = {"significance_share": ["tests"], "score_per_model": ["metrics"],
                 "finding_counts": ["findings", "recommendations", "conclusions"]}
        drawn = [name for name in made if all(n in self.tables for n in needs.get(name, []))]
        self.tables.update({name: made[name]() for name in drawn})
        return {"charts": len(drawn), "series": drawn}

    def final_report(self) -> dict:
        """Rows of the report: stages, findings, recommendations and the model."""
        places = {name: self.tables[name].select("place", column) for name, column in
                  (("findings", "finding"), ("recommendations", "recommendation")) if name in self.tables}
        sections = {"stages": (self._stages(), "stage", None)}
        sections |= {name: (part, part.columns[1], 5) for name, part in places.items()}
        if "metrics" in self.tables:
            sections["models"] = (self.tables["metrics"].select(F.lit(1).alias("place"), "model_name"), "model_name", 3)
        self.tables["report"] = insights.run_report(sections)
        return {"sections": sorted(sections)}


def default_comparison(data: DataFrame, task: str, n_features: int, n_classes: int) -> DataFrame:
    """All four models of the task by five-fold cross-validation."""
    if task == "classification":
        return models.compare_classifiers(data, n_features, n_classes)
    return models.compare_regressors(data)


def run_analysis(df: DataFrame, run_id: str, key: str, target: str, out: str | None = None, **options) -> DataFrame:
    return Analysis(df, run_id, key, target, out, **options).run()


def run_tables(tables: dict[str, tuple[DataFrame, str, str]], out: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The analysis of several tables by name, each ``(table, key, target)``.

    Gives all stage rows, and one row over the tables: how many were cleaned, rows before
    and after, duplicates, missing values and types (``clean.quality_rollup``).
    """
    if not tables:
        raise ValueError("no tables")
    results, summaries = [], []
    for name, (df, key, target) in tables.items():
        analysis = Analysis(df, name, key, target, out, **options)
        results.append(analysis.run())
        quality = next(r for r in analysis.rows if r[1] == "data_quality")
        found = json.loads(quality[4])
        summaries.append((name, quality[3], *[int(found.get(k) or 0) for k in (
            "original_rows", "cleaned_rows", "duplicates_removed", "missing_handled", "types_corrected")]))
    spark = results[0].sparkSession
    rollup = clean.quality_rollup(spark.createDataFrame(summaries, (
        "table_id string, status string, original_rows bigint, cleaned_rows bigint, duplicates_removed bigint, "
        "missing_handled bigint, types_corrected bigint")))
    return reduce(DataFrame.unionByName, results), rollup
