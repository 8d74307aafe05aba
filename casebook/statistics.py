"""Profiles, correlations and group tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.operators import profile, stats

from .fixtures import shape, sql_shape
from .registry import case, table

LINEITEM = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
            "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
            "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
GAPPY = ["event_id", "user_id", "amount", "kind", "rare", "parity", "one", "ts"]


def each(columns, sql: str) -> str:
    """The same SELECT for every column, under one another."""
    return " UNION ALL ".join(sql.replace("$C", c) for c in columns)


@case("duplicate_count", f"""
    SELECT CAST(SUM(n - 1) AS BIGINT) AS duplicates FROM
      (SELECT COUNT(*) AS n FROM {sql_shape('doubled')} GROUP BY event_id, user_id, event_type, value, ts)""")
def duplicate_count(spark, sf_dir):
    return profile.duplicate_count(shape(spark, sf_dir, "doubled"))


@case("missing_counts", each(GAPPY, f"SELECT '$C' AS \"column\", COUNT(*) - COUNT($C) AS n_missing FROM {sql_shape('gappy')}"))
def missing_counts(spark, sf_dir):
    return profile.missing_counts(shape(spark, sf_dir, "gappy"))


@case("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, COUNT(*) - COUNT({c}) AS n_missing, "
    f"ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 6) AS missing_pct, COUNT(DISTINCT {c}) AS n_distinct FROM lineitem"
    for c, t in LINEITEM.items()))
def column_profile(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "lineitem")).withColumn("missing_pct", F.round("missing_pct", 6))


@case("table_shape", "SELECT COUNT(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def table_shape(spark, sf_dir):
    return profile.table_shape(table(spark, sf_dir, "lineitem"))


_NUMERIC = list(LINEITEM)[:8]


@case("numeric_describe", each(_NUMERIC, """
    SELECT '$C' AS "column", COUNT($C) AS n, ROUND(AVG($C), 4) AS mean, ROUND(STDDEV_SAMP($C), 4) AS std, MIN($C)::DOUBLE AS min,
           ROUND(quantile_cont($C::DOUBLE, 0.25), 6) AS p25, ROUND(quantile_cont($C::DOUBLE, 0.5), 6) AS p50,
           ROUND(quantile_cont($C::DOUBLE, 0.75), 6) AS p75, MAX($C)::DOUBLE AS max FROM lineitem"""))
def numeric_describe(spark, sf_dir):
    found = profile.numeric_describe(table(spark, sf_dir, "lineitem"))
    return found.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4),
                              **{c: F.round(c, 6) for c in ("p25", "p50", "p75")}})


@case("numeric_minmax", each(["event_id", "user_id", "amount", "rare", "one"], f"""
    SELECT '$C' AS "column", MIN($C)::DOUBLE AS min, MAX($C)::DOUBLE AS max, ROUND(AVG($C), 4) AS mean,
           ROUND(median($C::DOUBLE), 6) AS median, ROUND(STDDEV_SAMP($C), 4) AS std FROM {sql_shape('gappy')}"""))
def numeric_minmax(spark, sf_dir):
    found = profile.numeric_minmax(shape(spark, sf_dir, "gappy"))
    return found.withColumns({"mean": F.round("mean", 4), "median": F.round("median", 6), "std": F.round("std", 4)})


@case("top_values", "SELECT \"column\", CAST(rank AS INT) AS rank, value, n, rank = 1 AS most_common FROM (" + each(
    ["p_name", "p_brand", "p_type"], """
    SELECT '$C' AS "column", $C AS value, COUNT(*) AS n, row_number() OVER (ORDER BY COUNT(*) DESC, $C) AS rank
    FROM part GROUP BY $C""") + ") WHERE rank <= 5")
def top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "part"))


@case("datetime_range", "SELECT 'l_shipdate' AS \"column\", MIN(l_shipdate) AS min_date, MAX(l_shipdate) AS max_date FROM lineitem")
def datetime_range(spark, sf_dir):
    return profile.datetime_range(table(spark, sf_dir, "lineitem"))


@case("categorical_cardinality", each(
    ["o_orderstatus", "o_orderpriority"], "SELECT '$C' AS \"column\", COUNT(DISTINCT $C) AS n_distinct FROM orders"))
def categorical_cardinality(spark, sf_dir):
    return profile.categorical_cardinality(table(spark, sf_dir, "orders"))


@case("dtype_families", f"""
    SELECT 'numeric' AS family, 5 AS n_columns, 'bigint, double' AS dtypes,
           CAST(SUM((amount IS NULL)::INT + (rare IS NULL)::INT) AS BIGINT) AS n_missing FROM {sql_shape('gappy')}
    UNION ALL SELECT 'string', 2, 'string', CAST(SUM((kind IS NULL)::INT) AS BIGINT) FROM {sql_shape('gappy')}
    UNION ALL SELECT 'datetime', 1, 'timestamp_ntz', 0""")
def dtype_families(spark, sf_dir):
    return profile.dtype_families(shape(spark, sf_dir, "gappy"))


def pairs_sql(columns: list[str], source: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS variable1, '{b}' AS variable2, COUNT(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
        f"corr({a}, {b}) AS r{extra} FROM {source}"
        for i, a in enumerate(columns) for b in columns[i + 1:])


_MATRIX = _NUMERIC


@case("correlation_matrix", f"""
    WITH half AS ({pairs_sql(_MATRIX, 'lineitem')})
    SELECT variable1, variable2, ROUND(r, 6) AS correlation FROM half
    UNION ALL SELECT variable2, variable1, ROUND(r, 6) FROM half
    UNION ALL {each(_MATRIX, "SELECT '$C', '$C', 1.0")}""")
def correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(table(spark, sf_dir, "lineitem").select(*_MATRIX)).withColumn(
        "correlation", F.round("correlation", 6))


@case("correlation_wide", f"""
    SELECT 'c_custkey' AS variable1, 1.0::DOUBLE AS c_custkey, ROUND(corr(c_custkey, c_nationkey), 6) AS c_nationkey, ROUND(corr(c_custkey, c_acctbal), 6) AS c_acctbal FROM customer
    UNION ALL SELECT 'c_nationkey', ROUND(corr(c_custkey, c_nationkey), 6), 1.0, ROUND(corr(c_nationkey, c_acctbal), 6) FROM customer
    UNION ALL SELECT 'c_acctbal', ROUND(corr(c_custkey, c_acctbal), 6), ROUND(corr(c_nationkey, c_acctbal), 6), 1.0 FROM customer""")
def correlation_wide(spark, sf_dir):
    wide = stats.correlation_wide(table(spark, sf_dir, "customer"))
    return wide.select("variable1", *[F.round(c, 6).alias(c) for c in wide.columns[1:]])


def beta_cte(tests: str, passes: int = 600) -> str:
    """I_x(a, b) for every row of ``tests(id, a, b, x)`` as ``tail(id, p)``: the continued fraction, one pass per level."""
    return f"""
    tests AS MATERIALIZED ({tests}),
    side AS (SELECT id, x > (a + 1) / (a + b + 2) AS turned, CASE WHEN x > (a + 1) / (a + b + 2) THEN b ELSE a END AS a,
                    CASE WHEN x > (a + 1) / (a + b + 2) THEN a ELSE b END AS b,
                    CASE WHEN x > (a + 1) / (a + b + 2) THEN 1 - x ELSE x END AS x FROM tests),
    steps(id, a, b, x, m, c, d, h) AS (
      SELECT id, a, b, x, 0, 1::DOUBLE, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1)) FROM side
      UNION ALL
      SELECT id, a, b, x, m + 1, 1 + o / c1, 1 / (1 + o * d1), h * (c1 * d1) * ((1 + o / c1) / (1 + o * d1)) FROM (
        SELECT *, 1 + e / c AS c1, 1 / (1 + e * d) AS d1 FROM (
          SELECT *, (m + 1) * (b - (m + 1)) * x / ((a + 2 * (m + 1) - 1) * (a + 2 * (m + 1))) AS e,
                 -(a + (m + 1)) * (a + b + (m + 1)) * x / ((a + 2 * (m + 1)) * (a + 2 * (m + 1) + 1)) AS o
          FROM steps WHERE m < {passes}))),
    tail AS (SELECT s.id, CASE WHEN s.x <= 0 THEN CASE WHEN s.turned THEN 1.0 ELSE 0.0 END
                           WHEN s.turned THEN 1 - front * t.h ELSE front * t.h END AS p
             FROM (SELECT *, CASE WHEN x > 0 THEN exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) / a END AS front FROM side) s
             JOIN steps t ON t.id = s.id AND t.m = {passes})"""


_TEST_COLUMNS = _NUMERIC


def correlation_tests_sql(pairs: str, kind: str) -> str:
    """Rows of a correlation test over ``pairs(variable1, variable2, n, r)``."""
    return f"""
    WITH RECURSIVE pairs AS MATERIALIZED (SELECT * FROM ({pairs}) WHERE isfinite(r)),
    {beta_cte("SELECT variable1 || '/' || variable2 AS id, (n - 2) / 2.0::DOUBLE AS a, 0.5::DOUBLE AS b, 1 - r * r AS x FROM pairs")}
    SELECT '{kind}' AS test_type, variable1, variable2, n, ROUND(r, 6) AS correlation, ROUND(p, 6) AS p_value,
           p < 0.05 AS significant, ROUND(abs(r), 6) AS effect_size
    FROM pairs JOIN tail ON tail.id = variable1 || '/' || variable2"""


def rounded_tests(tests):
    return tests.withColumns({c: F.round(c, 6) for c in ("correlation", "p_value", "effect_size")})


@case("pearson_test", correlation_tests_sql(pairs_sql(_TEST_COLUMNS, "lineitem"), "pearson_correlation"))
def pearson_test(spark, sf_dir):
    return rounded_tests(stats.pearson_test(table(spark, sf_dir, "lineitem"), _TEST_COLUMNS))


def ranked_pairs_sql(columns: list[str], source: str) -> str:
    """Correlations of average ranks, each pair ranked over its own complete rows."""
    return " UNION ALL ".join(f"""
      SELECT '{a}' AS variable1, '{b}' AS variable2, COUNT(*) AS n, corr(ra, rb) AS r FROM (
        SELECT rank() OVER (ORDER BY {a}) + (COUNT(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
               rank() OVER (ORDER BY {b}) + (COUNT(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
        FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for i, a in enumerate(columns) for b in columns[i + 1:])


@case("spearman_test", correlation_tests_sql(
    ranked_pairs_sql(["event_id", "user_id", "amount", "rare", "one"], sql_shape("gappy")), "spearman_correlation"))
def spearman_test(spark, sf_dir):
    return rounded_tests(stats.spearman_test(shape(spark, sf_dir, "gappy")))


def group_totals_sql(numeric: list[str], categories: list[str], source: str) -> str:
    """Sufficient statistics of every numeric by category test over groups of two rows or more."""
    cells = " UNION ALL ".join(
        f"SELECT '{n}' AS dep, '{c}' AS ind, {c}::VARCHAR AS grp, COUNT({n}) AS n, AVG({n}) AS m, VAR_SAMP({n}) AS v "
        f"FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT({n}) > 1" for n in numeric for c in categories)
    return f"""
    cells AS MATERIALIZED ({cells}),
    grand AS (SELECT dep, ind, COUNT(*) AS k, SUM(n) AS total, SUM(n * m) / SUM(n) AS g FROM cells GROUP BY 1, 2),
    sums AS (SELECT c.dep, c.ind, ANY_VALUE(k) AS k, ANY_VALUE(total) AS total, SUM(n * (m - g) ** 2) AS ssb,
                    SUM((n - 1) * v) AS ssw, arg_min(m, grp) AS m1, arg_max(m, grp) AS m2, arg_min(n, grp) AS n1, arg_max(n, grp) AS n2
             FROM cells c JOIN grand USING (dep, ind) GROUP BY 1, 2)"""


def group_tests_sql(numeric: list[str], categories: list[str], source: str) -> str:
    """``found(test_type, dep, ind, k, f, t, p)`` of all F tests and two-group t tests, after a WITH RECURSIVE."""
    return f"""{group_totals_sql(numeric, categories, source)},
    ready AS MATERIALIZED (
      SELECT 'anova' AS test_type, dep, ind, k, (ssb / (k - 1)) / NULLIF(ssw / (total - k), 0) AS f, NULL::DOUBLE AS t,
             (total - k) / 2.0::DOUBLE AS a, (k - 1) / 2.0::DOUBLE AS b, ssw / NULLIF(ssw + ssb, 0) AS x FROM sums WHERE k >= 2
      UNION ALL
      SELECT 't_test', dep, ind, k, NULL, t, free / 2.0::DOUBLE, 0.5::DOUBLE, free / (free + t * t) FROM (
        SELECT *, total - 2 AS free, (m1 - m2) / NULLIF(sqrt(ssw / (total - 2) * (1.0 / n1 + 1.0 / n2)), 0) AS t FROM sums WHERE k = 2)),
    {beta_cte("SELECT test_type || '/' || dep || '/' || ind AS id, a::DOUBLE AS a, b::DOUBLE AS b, x::DOUBLE AS x FROM ready")},
    found AS (SELECT ready.*, p FROM ready JOIN tail ON tail.id = test_type || '/' || dep || '/' || ind)"""


_GROUP_NUMERIC = _NUMERIC
_GROUP_CATEGORIES = ["l_returnflag", "l_linestatus"]
_GROUP_SELECT = """SELECT test_type, dep AS dependent_variable, ind AS independent_variable, k AS groups, ROUND(f, 6) AS f_statistic,
    ROUND(t, 6) AS t_statistic, ROUND(p, 6) AS p_value, p < 0.05 AS significant FROM found"""


def rounded_groups(tests):
    return tests.withColumns({c: F.round(c, 6) for c in ("f_statistic", "t_statistic", "p_value")})


@case("anova_oneway", f"WITH RECURSIVE {group_tests_sql(_GROUP_NUMERIC, _GROUP_CATEGORIES, 'lineitem')} {_GROUP_SELECT} WHERE test_type = 'anova'")
def anova_oneway(spark, sf_dir):
    return rounded_groups(stats.anova_oneway(table(spark, sf_dir, "lineitem"), _GROUP_NUMERIC, _GROUP_CATEGORIES))


@case("t_test_ind", f"WITH RECURSIVE {group_tests_sql(_GROUP_NUMERIC, _GROUP_CATEGORIES, 'lineitem')} {_GROUP_SELECT} WHERE test_type = 't_test'")
def t_test_ind(spark, sf_dir):
    return rounded_groups(stats.t_test_ind(table(spark, sf_dir, "lineitem"), _GROUP_NUMERIC, _GROUP_CATEGORIES))


@case("pick_grouping_column", 'SELECT "column", n_distinct FROM (' + " UNION ALL ".join(
    f"SELECT {i} AS i, '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_distinct FROM lineitem" for i, c in enumerate(_NUMERIC))
      + ") WHERE n_distinct BETWEEN 2 AND 10 ORDER BY i LIMIT 1")
def pick_grouping_column(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*_NUMERIC)
    chosen = profile.pick_grouping_column(df)
    return df.agg(F.lit(chosen).alias("column"), F.count_distinct(chosen).alias("n_distinct"))


_UNION_NUMERIC = ["event_id", "user_id", "amount", "rare", "one"]
_UNION_CATEGORIES = ["kind", "parity"]


def all_tests(spark, sf_dir):
    """Pearson, Spearman, F and t tests of one table."""
    df = shape(spark, sf_dir, "gappy")
    return stats.union_tests(stats.pearson_test(df), stats.spearman_test(df), stats.anova_oneway(df), stats.t_test_ind(df))


ALL_TESTS_SQL = f"""
    WITH RECURSIVE {group_tests_sql(_UNION_NUMERIC, _UNION_CATEGORIES, sql_shape('gappy'))},
    pearson AS (SELECT * FROM ({correlation_tests_sql(pairs_sql(_UNION_NUMERIC, sql_shape('gappy')), 'pearson_correlation')})),
    spearman AS (SELECT * FROM ({correlation_tests_sql(ranked_pairs_sql(_UNION_NUMERIC, sql_shape('gappy')), 'spearman_correlation')})),
    everything AS (
      SELECT test_type, variable1, variable2, n, correlation, p_value, significant, effect_size,
             NULL::VARCHAR AS dependent_variable, NULL::VARCHAR AS independent_variable, NULL::BIGINT AS groups, NULL::DOUBLE AS f_statistic, NULL::DOUBLE AS t_statistic
      FROM (SELECT * FROM pearson UNION ALL SELECT * FROM spearman)
      UNION ALL
      SELECT test_type, NULL, NULL, NULL, NULL, ROUND(p, 6), p < 0.05, NULL, dep, ind, k, ROUND(f, 6), ROUND(t, 6) FROM found)"""


def rounded_union(tests):
    return tests.withColumns({c: F.round(c, 6) for c in ("correlation", "p_value", "effect_size", "f_statistic", "t_statistic")})


@case("union_tests", f"{ALL_TESTS_SQL} SELECT * FROM everything")
def union_tests(spark, sf_dir):
    return rounded_union(all_tests(spark, sf_dir))


@case("significant_only", f"{ALL_TESTS_SQL} SELECT * FROM everything WHERE p_value < 0.05")
def significant_only(spark, sf_dir):
    return rounded_union(stats.significant_only(all_tests(spark, sf_dir)))


@case("stat_summary", f"""{ALL_TESTS_SQL}
    SELECT COUNT(*) AS total_tests, COUNT(*) FILTER (test_type LIKE '%correlation') AS correlation_tests,
           COUNT(*) FILTER (test_type NOT LIKE '%correlation') AS hypothesis_tests, COUNT(*) FILTER (significant) AS significant_tests,
           ROUND(COUNT(*) FILTER (significant) / COUNT(*), 6) AS significance_rate FROM everything""")
def stat_summary(spark, sf_dir):
    return stats.stat_summary(all_tests(spark, sf_dir)).withColumn("significance_rate", F.round("significance_rate", 6))


@case("average_rank", """
    SELECT c_custkey, rank() OVER (ORDER BY c_nationkey) + (COUNT(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0::DOUBLE AS rank FROM customer""")
def average_rank(spark, sf_dir):
    return stats.average_rank(table(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"])
