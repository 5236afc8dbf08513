"""Run registered queries against their SQL on DuckDB and compare rows exactly.

Usage: python tests/oracle_check.py [SF_DIR] [name-part ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    f = float(v)
    return "nan" if math.isnan(f) else f + 0.0


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    started = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if sql is None:
        return True, f"rows only: {sum(got.values())}", spent
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {set(got_cols) ^ set(want_cols)}", spent
    if got == want:
        return True, f"{sum(got.values())} rows", spent
    a, b = list((got - want).elements()), list((want - got).elements())
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(a, key=key), sorted(b, key=key)
    return False, f"rows {sum(got.values())} vs {sum(want.values())}; only here {len(a)}, only there {len(b)}\n   {got_cols}\n   spark {a[:2]}\n   duck  {b[:2]}", spent


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note, spent = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            ok, note, spent = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        bad += not ok
        print(("ok  " if ok else "FAIL"), name, f"{spent:.1f}s", note, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
