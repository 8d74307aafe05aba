"""Cleaning, re-typing and feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.operators import clean, features

from .aggregates import rounded
from .fixtures import shape, sql_shape
from .registry import case, table

_NUMBER = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"
_TEXTS = ["part_text", "bad_number", "ship_text", "flag"]


@case("suggest_types", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column",
           CASE WHEN COUNT(*) FILTER ({c} IS NOT NULL AND NOT regexp_matches({c}, {_NUMBER})) = 0 THEN 'numeric'
                WHEN COUNT(*) FILTER ({c} IS NOT NULL AND try_strptime({c}, '%Y-%m-%d') IS NULL) = 0 THEN 'datetime' ELSE 'object' END AS suggested_dtype,
           CASE WHEN COUNT(*) FILTER ({c} IS NOT NULL AND NOT regexp_matches({c}, {_NUMBER})) > 0
                 AND COUNT(*) FILTER ({c} IS NOT NULL AND try_strptime({c}, '%Y-%m-%d') IS NULL) = 0 THEN 'yyyy-MM-dd' END AS format
    FROM {sql_shape('messy')}""" for c in _TEXTS))
def suggest_types(spark, sf_dir):
    return clean.suggest_types(shape(spark, sf_dir, "messy"))


@case("cast_numeric", f"""
    SELECT l_orderkey, CASE WHEN regexp_matches(bad_number, {_NUMBER}) THEN CAST(bad_number AS DOUBLE) END AS bad_number,
           CAST(part_text AS DOUBLE) AS part_text
    FROM (SELECT l_orderkey, bad_number, part_text FROM {sql_shape('messy')})""".replace("CAST(bad_number", "TRY_CAST(bad_number"))
def cast_numeric(spark, sf_dir):
    return clean.cast_numeric(shape(spark, sf_dir, "messy"), ["bad_number", "part_text"]).select("l_orderkey", "bad_number", "part_text")


@case("cast_datetime", f"""
    SELECT l_orderkey, try_strptime(ship_text, '%Y-%m-%d') AS ship_text, try_strptime(bad_number, '%Y-%m-%d') AS bad_number FROM {sql_shape('messy')}""")
def cast_datetime(spark, sf_dir):
    return clean.cast_datetime(shape(spark, sf_dir, "messy"), {"ship_text": "yyyy-MM-dd", "bad_number": "yyyy-MM-dd"}).select(
        "l_orderkey", "ship_text", "bad_number")


@case("impute_median", f"""
    SELECT event_id, COALESCE(amount, (SELECT median(amount) FROM {sql_shape('gappy')})) AS amount,
           COALESCE(rare, (SELECT median(rare) FROM {sql_shape('gappy')})) AS rare FROM {sql_shape('gappy')}""")
def impute_median(spark, sf_dir):
    return clean.impute_median(shape(spark, sf_dir, "gappy"), ["amount", "rare"]).select("event_id", "amount", "rare")


@case("impute_mode", f"""
    SELECT event_id, COALESCE(kind, (SELECT kind FROM {sql_shape('gappy')} WHERE kind IS NOT NULL GROUP BY kind ORDER BY COUNT(*) DESC, kind LIMIT 1)) AS kind,
           parity FROM {sql_shape('gappy')}""")
def impute_mode(spark, sf_dir):
    return clean.impute_mode(shape(spark, sf_dir, "gappy"), ["kind", "parity"]).select("event_id", "kind", "parity")


@case("impute_mean", f"""
    SELECT event_id, ROUND(COALESCE(amount, (SELECT AVG(amount) FROM {sql_shape('gappy')})), 6) AS amount FROM {sql_shape('gappy')}""")
def impute_mean(spark, sf_dir):
    return rounded(clean.impute_mean(shape(spark, sf_dir, "gappy"), ["amount"]), "amount").select("event_id", "amount")


@case("impute_target", f"""
    SELECT event_id, COALESCE(kind, (SELECT kind FROM {sql_shape('gappy')} WHERE kind IS NOT NULL GROUP BY kind ORDER BY COUNT(*) DESC, kind LIMIT 1)) AS kind,
           ROUND(COALESCE(rare, (SELECT AVG(rare) FROM {sql_shape('gappy')})), 6) AS rare FROM {sql_shape('gappy')}""")
def impute_target(spark, sf_dir):
    classes = clean.impute_target(shape(spark, sf_dir, "gappy"), "kind", "classification")
    return rounded(clean.impute_target(classes, "rare", "regression"), "rare").select("event_id", "kind", "rare")


_DEDUP = f"(SELECT DISTINCT * FROM {sql_shape('messy')})"


@case("clean_table", f"""
    WITH d AS MATERIALIZED (SELECT DISTINCT * FROM {sql_shape('messy')})
    SELECT l_orderkey, l_linenumber, CAST(part_text AS DOUBLE) AS part_text, bad_number, strptime(ship_text, '%Y-%m-%d') AS ship_text,
           COALESCE(quantity, (SELECT median(quantity) FROM d)) AS quantity,
           COALESCE(flag, (SELECT flag FROM d WHERE flag IS NOT NULL GROUP BY flag ORDER BY COUNT(*) DESC, flag LIMIT 1)) AS flag FROM d""")
def clean_table(spark, sf_dir):
    cleaned, _ = clean.clean_table(shape(spark, sf_dir, "messy"))
    return cleaned


@case("cleaning_summary", f"""
    SELECT 'messy' AS table_id, 'success' AS status, COUNT(*) AS original_rows, (SELECT COUNT(*) FROM {_DEDUP}) AS cleaned_rows,
           COUNT(*) - (SELECT COUNT(*) FROM {_DEDUP}) AS duplicates_removed,
           CAST(SUM((quantity IS NULL)::INT + (flag IS NULL)::INT + (rare_tax IS NULL)::INT) AS BIGINT) AS missing_handled, 2 AS types_corrected
    FROM {sql_shape('messy')}""")
def cleaning_summary(spark, sf_dir):
    return clean.cleaning_summary(shape(spark, sf_dir, "messy"), "messy")


@case("encode_binary", f"""
    SELECT event_id, CAST(parity = 'even' AND (SELECT COUNT(*) FILTER (parity = 'even') >= COUNT(*) FILTER (parity = 'odd') FROM {sql_shape('gappy')})
             OR parity = 'odd' AND (SELECT COUNT(*) FILTER (parity = 'even') < COUNT(*) FILTER (parity = 'odd') FROM {sql_shape('gappy')}) AS INT) AS parity
    FROM {sql_shape('gappy')}""")
def encode_binary(spark, sf_dir):
    return features.encode_binary(shape(spark, sf_dir, "gappy"), ["parity"]).select("event_id", "parity")


@case("encode_label", f"""
    SELECT event_id, dense_rank() OVER (ORDER BY COALESCE(kind, 'nan')) - 1 AS kind FROM {sql_shape('gappy')}""")
def encode_label(spark, sf_dir):
    return features.encode_label(shape(spark, sf_dir, "gappy"), ["kind"]).select("event_id", "kind")


_SCALE = "(({c} - (SELECT AVG({c}) FROM {t})) / (SELECT CASE STDDEV_POP({c}) WHEN 0 THEN 1 ELSE STDDEV_POP({c}) END FROM {t}))"


def scaled(column: str, source: str) -> str:
    return _SCALE.format(c=column, t=source)


@case("scale_standard", f"""
    SELECT event_id, ROUND({scaled('amount', sql_shape('gappy'))}, 6) AS amount, ROUND({scaled('one', sql_shape('gappy'))}, 6) + 0.0 AS one FROM {sql_shape('gappy')}""")
def scale_standard(spark, sf_dir):
    found = features.scale_standard(shape(spark, sf_dir, "gappy"), ["amount", "one"])
    return rounded(found, "amount", "one").select("event_id", "amount", "one")


@case("scale_normalize", """
    SELECT l_orderkey, l_linenumber, """ + f"ROUND({scaled('l_extendedprice', 'lineitem')}, 6) AS l_extendedprice FROM lineitem")
def scale_normalize(spark, sf_dir):
    found = features.scale_normalize(table(spark, sf_dir, "lineitem"), ["l_extendedprice"])
    return rounded(found, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice")


@case("ratio_features", """
    SELECT p_partkey, ROUND(p_size / p_retailprice, 6) AS p_size_div_p_retailprice, ROUND(p_partkey / p_size, 6) AS p_partkey_div_p_size,
           ROUND(p_partkey / p_retailprice, 6) AS p_partkey_div_p_retailprice FROM part""")
def ratio_features(spark, sf_dir):
    found, made = features.ratio_features(table(spark, sf_dir, "part"), ["p_partkey", "p_size", "p_retailprice"])
    return rounded(found, *made).select("p_partkey", *made)


@case("square_feature", "SELECT c_custkey, ROUND(c_acctbal * c_acctbal, 4) AS c_acctbal_squared FROM customer")
def square_feature(spark, sf_dir):
    found, _ = features.square_feature(table(spark, sf_dir, "customer"), "c_acctbal")
    return rounded(found, "c_acctbal_squared", places=4).select("c_custkey", "c_acctbal_squared")


@case("bin_features", """
    WITH e AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(LEAST(floor((l_extendedprice - lo) / (hi - lo) * 8) + 1, 8) AS INT) AS l_extendedprice_bin,
           CAST(1 + (l_quantity > (SELECT quantile_cont(l_quantity, 0.25) FROM lineitem))::INT + (l_quantity > (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem))::INT
                  + (l_quantity > (SELECT quantile_cont(l_quantity, 0.75) FROM lineitem))::INT AS INT) AS l_quantity_bin FROM lineitem, e""")
def bin_features(spark, sf_dir):
    found = features.bin_features(table(spark, sf_dir, "lineitem"), "l_extendedprice", 8)
    found = features.bin_features(found, "l_quantity", 4, equal_width=False)
    return found.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_extendedprice_bin", "l_quantity_bin")


_NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]
_RATIOS = [("c_custkey", "c_nationkey"), ("c_custkey", "c_acctbal"), ("c_nationkey", "c_acctbal")]


@case("transform_features", f"""
    WITH s AS (SELECT {", ".join(f"{scaled(c, 'customer')} AS {c}" for c in _NUMBERS)}, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name,
                 dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment, CAST(c_custkey % 3 <> 0 AS INT) AS side FROM customer)
    SELECT {", ".join(f"ROUND({c}, 6) AS {c}" for c in _NUMBERS)}, c_name, c_mktsegment, side,
           {", ".join(f"ROUND({a} / {b}, 4) AS {a}_div_{b}" for a, b in _RATIOS)}, ROUND(c_custkey * c_custkey, 6) AS c_custkey_squared FROM s""")
def transform_features(spark, sf_dir):
    source = table(spark, sf_dir, "customer").withColumn("side", F.when(F.col("c_custkey") % 3 == 0, "x").otherwise("y"))
    found, _ = features.transform_features(source)
    return rounded(rounded(found, *_NUMBERS, "c_custkey_squared"), *[f"{a}_div_{b}" for a, b in _RATIOS], places=4)
