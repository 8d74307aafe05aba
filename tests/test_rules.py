"""The rules that are easy to get wrong, on frames of a few rows."""

import math

import pytest
from pyspark.sql import functions as F

from sondage import quantiles
from sondage.functions import parsing, text as t
from sondage.functions.distributions import incomplete_beta, t_p_value
from sondage.operators import catalog, charts, clean, features, models, profile, search, stats
from sondage.ordering import Lookup, dense_index, lookup_join


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (None,), (float("nan"),)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"] == [1.75, 3.0, 5.0]


@pytest.mark.parametrize("seed,sketch,margin", [(1, 800, 0.012), (2, 50, 0.012), (3, 8, 1e-9)])
def test_quantiles_equal_the_builtin(spark, seed, sketch, margin):
    """Hot values, wide ranges, infinities and gaps; brackets that are right at once, and such as have to be widened."""
    df = spark.range(20_000).select(
        F.when(F.rand(seed) < 0.35, 7.0).otherwise(F.exp(F.randn(seed) * 9)).alias("a"),
        F.when(F.rand(seed + 9) < 0.2, None).otherwise(F.floor(F.rand(seed) * 5)).alias("b"),
        F.when(F.col("id") < 30, float("-inf")).when(F.col("id") > 19_900, float("inf")).otherwise(F.randn(seed)).alias("c"),
        F.lit(None).cast("double").alias("d"))
    df = df.persist()
    probabilities = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = quantiles.exact_quantiles(df, ["a", "b", "c", "d"], probabilities, sketch, margin)
    wanted = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, probabilities))) for c in "abc"]).first()
    for i, c in enumerate("abc"):
        assert found[c] == pytest.approx(list(wanted[i]), rel=1e-12)
    assert found["d"] == [None] * len(probabilities)


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert profile.column_modes(df, ["x"]) == {"x": "a"}


def test_standard_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    assert rows(features.scale_standard(df), "x", "k") == [(-1.0, 0.0), (1.0, 0.0)]


def test_describe_uses_the_sample_deviation(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert profile.numeric_describe(df).first()["std"] == pytest.approx(math.sqrt(2))


def test_binary_means_two_values_besides_null(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "two string, three string")
    assert rows(profile.column_roles(df), "column", "role") == [("three", "categorical"), ("two", "binary")]


def test_correlation_is_pairwise_complete_and_needs_three_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.5, 2.0), (4.0, None, 1.5)], "a double, b double, c double")
    found = {(r["variable1"], r["variable2"]): r for r in stats.pearson_test(df).collect()}
    assert set(found) == {("a", "b"), ("a", "c")}
    assert found[("a", "b")]["n"] == 3
    assert found[("a", "c")]["correlation"] == pytest.approx(0.5)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "a double, b double")
    assert stats.correlation_pairs(df).first()["correlation"] is None
    assert stats.pearson_test(df).count() == 0


def test_t_test_pools_and_subtracts_the_second_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 6.0), ("c", 9.0)], "g string, x double")
    row = stats.t_test_ind(df).first()
    assert row["t_statistic"] == pytest.approx(-3 / math.sqrt(4 / 3 * (1 / 3 + 1 / 2)))
    f = stats.anova_oneway(df).first()
    assert f["f_statistic"] == pytest.approx(row["t_statistic"] ** 2)
    assert f["p_value"] == pytest.approx(row["p_value"], abs=1e-12)


def test_numeric_table_groups_by_a_column_but_not_itself(spark):
    df = spark.createDataFrame([(i, i % 2, float(i * i)) for i in range(20)], "id long, side long, x double")
    assert {r["dependent_variable"] for r in stats.anova_oneway(df).collect()} == {"id", "x"}


def plain_beta(a, b, x):
    """The integral of t^(a-1) (1-t)^(b-1), by the substitution t = sin² u and Simpson's rule."""
    def area(end, steps=20000):
        end = math.asin(math.sqrt(end))
        heights = [2 * math.sin(u) ** (2 * a - 1) * math.cos(u) ** (2 * b - 1) for u in (end * k / steps for k in range(steps + 1))]
        return end / steps / 3 * (heights[0] + heights[-1] + 4 * sum(heights[1:-1:2]) + 2 * sum(heights[2:-1:2]))
    return area(x) / area(1.0)


def test_published_points_and_plain_integrals(spark):
    known = [(5.0, 0.5, 10 / (10 + 2.228139**2), 0.05), (5.0, 0.5, 10 / (10 + 4.964603), 0.05), (2.0, 3.0, 0.5, 0.6875)]
    known += [(a, b, x, plain_beta(a, b, x)) for a in (1.0, 2.5, 40.0) for b in (0.5, 1.0, 12.0) for x in (0.01, 0.4, 0.9)]
    known += [(3.0, 2.0, 0.0, 0.0), (3.0, 2.0, 1.0, 1.0), (0.0, 1.0, 0.5, None), (float("nan"), 1.0, 0.5, None), (1.0, None, 0.5, None)]
    df = spark.createDataFrame(known, "a double, b double, x double, wanted double")
    found = df.withColumn("p", incomplete_beta(F.col("a"), F.col("b"), F.col("x")))
    for r in found.collect():
        assert r["p"] == pytest.approx(r["wanted"], abs=1e-6) if r["wanted"] is not None else r["p"] is None
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    # The parameters of a test over 200 million rows lose no digits: I_x(a, 1/2) is the tail of t = 1.96.
    free = 2e8
    row = spark.createDataFrame([(free,)], "d double").select(t_p_value(F.lit(1.959963984540054), F.col("d")).alias("p")).first()
    assert row["p"] == pytest.approx(0.05, abs=1e-8)


def test_three_hundred_columns_in_one_pass(spark):
    df = spark.range(60).select(*[F.sin(F.col("id") * (k + 1)).alias(f"c{k}") for k in range(300)])
    found = stats.correlation_pairs(df)
    row = found.where("variable1 = 'c3' and variable2 = 'c250'").first()
    assert found.count() == 300 * 299 // 2 and row["n"] == 60
    assert row["correlation"] == pytest.approx(df.agg(F.corr("c3", "c250")).first()[0])


def test_a_column_with_an_infinity_has_no_correlation_not_even_its_own(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (float("inf"), 3.0, 1.0), (4.0, 5.0, 1.0), (None, 7.0, 1.0)], "a double, b double, k double")
    found = {(r["variable1"], r["variable2"]): r["correlation"] for r in stats.correlation_matrix(df).collect()}
    assert len(found) == 9 and found[("b", "b")] == 1.0
    assert all(v is None for k, v in found.items() if k != ("b", "b"))


def test_ranks_of_pairs_with_gaps_are_those_of_their_common_rows(spark):
    import random
    rnd = random.Random(4)
    rows = [tuple(None if rnd.random() < g else float(rnd.randrange(5)) for g in (0.0, 0.3, 0.5, 0.0, 0.9)) for _ in range(80)]
    rows[3] = (2.0, float("nan"), -0.0, 1.0, None)
    names = list("abcde")
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r["variable1"], r["variable2"]): r for r in stats.spearman_pairs(df).collect()}

    def ranks(values):
        return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]

    there = lambda v: v is not None and v == v
    for i in range(5):
        for j in range(i + 1, 5):
            both = [(r[i], r[j]) for r in rows if there(r[i]) and there(r[j])]
            x, y = ranks([b[0] for b in both]), ranks([b[1] for b in both])
            mx, my = sum(x) / len(x), sum(y) / len(y)
            sx, sy = sum((v - mx) ** 2 for v in x), sum((v - my) ** 2 for v in y)
            row = got[names[i], names[j]]
            assert row["n"] == len(both)
            if sx and sy:
                assert row["correlation"] == pytest.approx(sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sx * sy))
            else:
                assert row["correlation"] is None
    kept = stats.average_rank(df.withColumn("id", F.monotonically_increasing_id()), "c", ["id", "a"])
    assert kept.count() == 80 and kept.where("rank is null").count() == sum(not there(r[2]) for r in rows)


def test_seventy_category_columns(spark):
    df = spark.range(40).select("id", *[(F.col("id") % (2 + k % 3)).cast("string").alias(f"g{k}") for k in range(70)])
    assert stats.anova_oneway(df).count() == 70
    assert stats.group_moments(df, ["id"], [f"g{k}" for k in range(70)]).count() == sum(2 + k % 3 for k in range(70))


def test_ratios_and_square_use_scaled_columns(spark):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0)], "a double, b double")
    made, plan = features.transform_features(df)
    assert rows(made, "a_div_b", "a_squared") == [(1.0, 1.0), (1.0, 1.0)]


def test_ratio_is_skipped_when_the_divisor_reaches_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert features.ratio_features(df)[1] == {}


def test_labels_follow_code_points_and_null_reads_nan(spark):
    df = spark.createDataFrame([("b",), ("B",), ("é",), (None,), ("b",)], "x string")
    assert sorted(r["x"] for r in features.encode_label(df, ["x"]).collect()) == [0, 1, 1, 2, 3]


def test_types_that_java_would_accept_are_no_numbers(spark):
    df = spark.createDataFrame([("1d", "1", "2024-01-05", "x"), ("NaN", " -.5e3 ", "2024-12-31", None)], "a string, b string, c string, d string")
    found = {r["column"]: (r["suggested_dtype"], r["format"]) for r in clean.suggest_types(df).collect()}
    assert found == {"a": ("object", None), "b": ("numeric", None), "c": ("datetime", "yyyy-MM-dd"), "d": ("object", None)}


def test_cleaning_drops_imputes_and_retypes(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None, "5", None), (2, None, "u", "6", None), (3, 3.0, "u", "7", 1.0), (3, 3.0, "u", "7", 1.0), (4, 8.0, "v", "8", None)],
        "id int, num double, cat string, txt string, sparse double")
    cleaned, plan = clean.clean_table(df)
    assert plan.dropped == ["sparse"] and plan.rows_after_dedup == 4
    assert rows(cleaned, "id", "num", "cat", "txt") == [(1, 1.0, "u", 5.0), (2, 3.0, "u", 6.0), (3, 3.0, "u", 7.0), (4, 8.0, "v", 8.0)]


def test_dedup_is_idempotent_and_nulls_are_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, float("nan")), (2, float("nan"))], "a int, b double")
    once = clean.drop_duplicates(df)
    assert once.count() == 2 == clean.drop_duplicates(once).count()
    assert profile.duplicate_count(df).first()[0] == 2


def test_histogram_counts_every_value_and_closes_the_last_bin(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"), F.lit(3.0).alias("k"))
    found = charts.histogram(df, bins=10).collect()
    assert sum(r["n"] for r in found if r["column"] == "x") == 101
    assert {r["bin"]: r["n"] for r in found if r["column"] == "x"}[9] == 11
    assert [(r["lower"], r["upper"]) for r in found if r["column"] == "k"] == [(3.0, 3.1)]


def test_missing_values_have_no_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (None,), (float("nan"),)], "x double")
    assert sum(r["n"] for r in charts.histogram(df).collect()) == 2
    for equal in (True, False):
        assert sorted(str(r["x_bin"]) for r in features.bin_features(df, "x", 2, equal).collect()) == ["1", "2", "None", "None"]


def test_folds_partition_the_rows(spark):
    df = spark.range(23).withColumn("y", (F.col("id") % 3).cast("string"))
    assert [r[1] for r in models.kfold_assign(df, "id").groupBy("fold").count().orderBy("fold").collect()] == [5, 5, 5, 4, 4]
    folds = models.stratified_kfold_assign(df, "id", "y").groupBy("fold").count().orderBy("fold").collect()
    assert sum(r[1] for r in folds) == 23 and {r[0] for r in folds} == {0, 1, 2, 3, 4}


def test_global_position_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"))
    assert dense_index(df, [F.col("v")]).where("position >= 0").orderBy("v").select("position").agg(
        F.sum((F.col("position") < 0).cast("int")), F.count_distinct("position"), F.max("position")).first()[1:] == (5000, 4999)


def test_lookup_of_hot_keys_loses_nothing(spark, monkeypatch):
    """The way for large lookup tables, forced: one key holds a third of the rows, another part has none."""
    import sondage.ordering as ordering

    monkeypatch.setattr(ordering, "_BROADCAST_ROWS", 0)
    df = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")))
    counts = df.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("value", F.col("k") * 10)
    joined = lookup_join(df, Lookup(counts, counts.count(), 3000), F.col("k"), "k", ["value"])
    assert joined.count() == 3000
    assert joined.where("not (value <=> k * 10)").count() == 0


def test_spearman_of_large_lookups_equals_the_small_way(spark, monkeypatch):
    import sondage.ordering as ordering

    df = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1.0).alias("a"), (F.col("id") % 11).alias("b"),
        F.when(F.col("id") % 4 != 0, F.col("id") % 17).alias("c"))
    small = rows(stats.spearman_test(df), "variable1", "variable2", "correlation")
    monkeypatch.setattr(ordering, "_BROADCAST_ROWS", 0)
    large = rows(stats.spearman_test(df), "variable1", "variable2", "correlation")
    assert [r[:2] for r in small] == [r[:2] for r in large]
    assert [r[2] for r in small] == pytest.approx([r[2] for r in large])


def test_top_k_of_many_questions_equals_the_expression(spark):
    data = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * F.col("id"))).alias("embedding"))
    data = data.repartition(5).persist()
    question = list(data.where("id = 17").first()["embedding"])
    single = [r["id"] for r in search.semantic_topk(data, question, 5, "id").collect()]
    many = search.topk_per_question(data, [(1, question), (2, [0.0] * 8)], 5, "id")
    assert [r["id"] for r in many.where("question_id = 1").orderBy("rank").collect()] == single
    assert [r["id"] for r in many.where("question_id = 2").orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_zero_vector_has_similarity_zero(spark):
    from sondage.functions.vectors import cosine_similarity

    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert sorted(r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()) == [0.0, 1.0]


def test_replies(spark):
    df = spark.createDataFrame([('{"score": "0.7"}',), ("Score: .5 good",), ("none",)], "r string")
    found = [tuple(r) for r in df.select(*parsing.relevance_reply(F.col("r"))).collect()]
    assert found == [(0.7, "", "success"), (0.5, "Score: .5 good", "parsed_text"), (0.0, "none", "parsed_text")]


def test_queries_of_a_question(spark):
    df = spark.createDataFrame([("How does housing affect health?",), ("is it on",)], "q string")
    first, second = [r[0] for r in df.select(t.generate_search_queries(F.col("q"))).collect()]
    assert first[:4] == ["How does housing affect health?", "housing", "housing dataset", "housing data"]
    assert first[-3:] == ["housing affect", "housing affect dataset", "housing affect health"]
    assert second == ["is it on"]


def test_relevance_without_words_is_one_half(spark):
    df = spark.createDataFrame([("some text", "is it on"), ("HOUSING data", "housing costs?")], "x string, q string")
    assert [r[0] for r in df.select(t.keyword_relevance(F.col("x"), F.col("q"))).collect()] == [0.5, 0.7]
    assert df.select(t.keyword_relevance(F.col("x"), "the data")).first()[0] == 0.5


def test_dates_and_stems(spark):
    df = spark.createDataFrame([("2024-03-05T10:00:00Z", "a/b.tar.gz"), ("soon", ".hidden")], "d string, p string")
    assert rows(df.select(t.format_date(F.col("d")).alias("d"), t.file_stem(F.col("p")).alias("s")), "d", "s") == [
        ("March 05, 2024", "b.tar"), ("soon", ".hidden")]


def test_summaries_are_rows_in_order(spark):
    from sondage.operators import insights

    df = spark.range(10).select(F.lit("r").alias("run"), "id", F.lit("success").alias("status"), F.col("id").cast("string").alias("summary"))
    failed = spark.createDataFrame([("s", 1, "failed", "x")], "run string, id long, status string, summary string")
    found = rows(insights.combine_summaries(df.unionByName(failed), ["run"], "id"), "run", "position", "summary")
    assert found == [*[("r", k, str(k)) for k in range(10)], ("s", 0, "No dataset summaries available.")]


def test_a_run_gets_its_whole_text(spark, monkeypatch):
    from sondage.operators import insights

    monkeypatch.setattr(insights, "SUMMARIES_PER_PART", 4)
    df = spark.range(10).select(F.lit("r").alias("run"), "id", F.lit("success").alias("status"), F.col("id").cast("string").alias("summary"))
    others = spark.createDataFrame([("s", 1, "failed", "x"), ("t", 2, "success", "No dataset summaries available."), ("t", 1, "success", None)],
                                   "run string, id long, status string, summary string")
    found = rows(insights.combined_text(df.unionByName(others), ["run"], "id"), "run", "part", "n_summaries", "combined")
    assert found == [("r", 0, 4, "0 1 2 3"), ("r", 1, 4, "4 5 6 7"), ("r", 2, 2, "8 9"),
                     ("s", 0, 0, "No dataset summaries available."), ("t", 0, 1, "No dataset summaries available.")]


def test_odd_names_and_limits(spark):
    from sondage.operators import tasks

    df = spark.createDataFrame([(1, "x", 2), (1, "x", 2), (3, "y", 4)], "_n int, `a.b` string, _key int")
    assert profile.duplicate_count(df).first()["duplicates"] == 1
    assert [r["total_rows"] for r in profile.sample_rows(df, ["a.b"], 2).collect()] == [3, 3]
    odd = df.withColumn("nothing", F.lit(None))
    cleaned, plan = clean.clean_table(odd)
    assert cleaned.count() == plan.rows_after_dedup == 2 and plan.dropped == ["nothing"]
    queued = spark.range(40).select("id", (F.col("id") % 20).alias("agent_id"), (F.col("id") % 4).alias("priority"), F.col("id").alias("created_at"))
    running = spark.createDataFrame([(100 + k, 50 + k) for k in range(7)], "id long, agent_id long")
    assert [r["id"] for r in tasks.dispatch_order(queued, running).orderBy("id").collect()] == [3, 7, 11]
    assert tasks.dispatch_order(queued, running.union(running)).count() == 0


def test_rows_without_a_label_stay(spark):
    df = spark.range(30).withColumn("y", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    assert models.stratified_kfold_assign(df, "id", "y").count() == 30
    split = models.stratified_split(df, "id", "y")
    assert split.count() == 30 and split.where("is_test").groupBy("y").count().select("count").distinct().collect() == [(2,)]


def test_failed_results_and_missing_status(spark):
    df = spark.createDataFrame([("a", "failed"), ("b", None), ("c", "success")], "stage string, status string")
    assert rows(catalog.stage_not_failed(df), "stage") == [("b",), ("c",)]


def test_best_model_with_only_bad_scores(spark):
    stats_table = spark.createDataFrame([("A", -3.0, 0.1), ("B", -2.0, 0.1), ("C", None, None)], "model string, mean_score double, std_score double")
    assert models.recommend_model(stats_table, "regression").first()["model_name"] == "B"


def test_many_columns_give_ratios(spark):
    df = spark.range(3).select(*[(F.col("id") + k + 1).cast("double").alias(f"c{k}") for k in range(41)])
    wide, made = features.ratio_features(df)
    assert len(made) == 41 * 40 // 2 and len(wide.columns) == 41 + len(made)


def test_infinity_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, float("inf")), (3.0, 5.0)], "a double, b double")
    rows = stats.pearson_test(df).collect()
    assert all(r["correlation"] is None for r in rows)


def test_no_text_columns_give_no_values(spark):
    df = spark.range(3).select(F.col("id").cast("double").alias("x"))
    assert profile.top_values(df).count() == 0


def test_missing_families_give_empty_tables(spark):
    text = spark.createDataFrame([("a",)], "s string")
    numbers = spark.createDataFrame([(1.0,)], "x double")
    for operator in (profile.numeric_describe, profile.numeric_minmax, profile.datetime_range, stats.column_pairs,
                     stats.num_by_cat_grid, stats.correlation_matrix, charts.histogram, charts.box_stats):
        assert operator(text).count() == 0
    assert clean.suggest_types(numbers).count() == 0
    assert stats.correlation_matrix(numbers).count() == 0


def test_infinities_have_no_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (float("inf"),), (float("-inf"),)], "x double")
    found = charts.histogram(df, bins=3).orderBy("bin").collect()
    assert [(r["bin"], r["lower"], r["upper"], r["n"]) for r in found] == [(0, 0.0, 1.0, 1), (1, 1.0, 2.0, 1), (2, 2.0, 3.0, 1)]


@pytest.mark.parametrize("room", [32 << 20, 250, 0])
def test_labels_are_the_same_by_broadcast_and_by_one_join(spark, monkeypatch, room):
    monkeypatch.setattr(features, "BROADCAST_BYTES", room)
    rows = [(k, f"k{k % 3}", f"value {k % 40}" if k % 7 else None, "hot" if k % 2 else str(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "code int, a string, `b.c` string, _key string").repartition(3)
    got = {r["code"]: r for r in features.encode_label(df, ["a", "b.c", "_key"]).collect()}
    for place, column in enumerate(["a", "b.c", "_key"], start=1):
        words = sorted({r[place] or "nan" for r in rows})
        assert all(got[r[0]][column] == words.index(r[place] or "nan") for r in rows)


def test_look_ups_leave_other_columns_alone(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "_held int, _key string, _salt int")
    table = spark.createDataFrame([("x", 10, 1)], "value string, code int, n bigint")
    got = lookup_join(df, Lookup(table, 1, 1), F.col("_key"), "value", ["code"])
    assert got.columns == ["_held", "_key", "_salt", "code"] and sorted(r["code"] or 0 for r in got.collect()) == [0, 10]
