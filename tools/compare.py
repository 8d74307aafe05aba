"""Run registered queries beside their SQL on the same tables and report differences.

    python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, bool) or value is None:
        return value
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def kind(dtype: str) -> str:
    """Type classes in which the two engines should agree."""
    text = dtype.lower()
    for name, parts in {
        "int": ("bigint", "int", "smallint", "tinyint", "hugeint"), "double": ("double", "float"),
        "decimal": ("decimal",), "string": ("string", "varchar"), "boolean": ("boolean",), "time": ("timestamp", "date"),
    }.items():
        if text.startswith(parts):
            return name
    return text


def compare(frame: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """Nothing when equal, else what differs."""
    expected = connection.sql(sql)
    names = sorted(frame.columns)
    if names != sorted(expected.columns):
        return f"columns {names} vs {sorted(expected.columns)}"
    left_types = {f.name: kind(f.dataType.simpleString()) for f in frame.schema.fields}
    right_types = {n: kind(str(t)) for n, t in zip(expected.columns, expected.types)}
    odd = {n: (left_types[n], right_types[n]) for n in names if left_types[n] != right_types[n]}
    left = sorted((tuple(repr(plain(r[n])) for n in names) for r in frame.collect()))
    places = [expected.columns.index(n) for n in names]
    right = sorted((tuple(repr(plain(r[p])) for p in places) for r in expected.fetchall()))
    if odd:
        return f"types {odd}"
    if left != right:
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        return (f"rows {len(left)} vs {len(right)} {names}\n   spark {str(only_left)[:600]}\n"
                f"   sql   {str(only_right)[:600]}")
    return None if left else "no rows"


def main() -> int:
    from casebook import CASES, ORACLES
    from sondage.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.log.level": "OFF"})
    connection = connect(sf_dir)
    bad = 0
    spark.range(8).groupBy("id").count().collect()  # start-up is not part of the first query's time
    for name in args or list(CASES):
        start = time.time()
        try:
            frame = CASES[name](spark, sf_dir)
            if name in ORACLES:
                found = compare(frame, connection, ORACLES[name])
                mark = "ok  " if found is None else "DIFF"
            else:
                n = len(frame.collect())
                found, mark = (None, f"rows {n}") if n else ("no rows", "DIFF")
        except Exception:
            found, mark = traceback.format_exc()[-1500:], "FAIL"
        bad += found is not None
        print(f"{mark} {name} {time.time() - start:.2f}s" + (f"\n   {found}" if found else ""), flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
