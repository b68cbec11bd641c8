"""Run registered queries and their checking SQL side by side.

    python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The tables on which tests run.
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canon(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return f"b:{bool(v)}"
    if isinstance(v, float):
        return f"f:{v!r}"
    if isinstance(v, pd.Timestamp):
        return f"t:{v.isoformat()}"
    if hasattr(v, "item"):
        return _canon(v.item())
    return f"{type(v).__name__}:{v}"


def frame_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_canon(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> tuple[str, int, float]:
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return "rows-only", len(got), took
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(want_cols)}", len(got), took
    a, b = frame_rows(df.columns, got), frame_rows(want_cols, want)
    if a == b:
        return "ok", len(got), took
    only_a, only_b = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
    return f"DIFF {len(a)} vs {len(b)}\n  spark: {only_a[:3]}\n  check: {only_b[:3]}", len(got), took


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1]
    qs, sqls = entry.queries(), entry.oracle_sql()
    spark, con = session(), connect(sf)
    bad = 0
    for name in sys.argv[2:] or qs:
        try:
            state, count, took = compare(spark, con, qs[name], sqls.get(name), sf)
        except Exception as e:  # report and go on
            state, count, took = f"ERROR {str(e)[:1500]}", 0, 0.0
        bad += state not in ("ok", "rows-only")
        if count == 0:
            state += " EMPTY"
        print(f"{name:24s} {count:7d} {took:6.2f}s {state}", flush=True)
    print("bad:", bad, "of", len(qs), "without sql:", sorted(set(qs) - set(sqls)))
