"""Run queries against their SQL statements in DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(pdf: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA:
            return "\0"
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return tuple(one(x) for x in v)
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return "\0" if math.isnan(v) else f"{v:.6f}"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, int):
            return f"{float(v):.6f}"
        return str(v)

    cols = sorted(pdf.columns)
    return sorted(tuple(one(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None))


def diff(spark, sf_dir, con, fn, sql) -> str | None:
    got = fn(spark, sf_dir).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canon(got), canon(want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}\n got {a[:2]}\nwant {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)}/{len(a)} rows differ, cols {sorted(got.columns)}\n got {bad[0][0]}\nwant {bad[0][1]}"
    return None


def session(**conf):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config(
        "spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1]
    pats = sys.argv[2:]
    spark = session()
    if pats and pats[0].startswith("split="):
        spark.conf.set("onsetry.splitRows", pats.pop(0)[6:])
    con = oracle(f"/root/testdata/sf{sf}")
    qs, sqls, bad = queries(), oracle_sql(), []
    for name, fn in qs.items():
        if pats and not any(name.startswith(p) for p in pats):
            continue
        t = time.time()
        try:
            if name in sqls:
                msg = diff(spark, f"/root/testdata/sf{sf}", con, fn, sqls[name])
                n = "oracle"
            else:
                n, msg = f"{fn(spark, f'/root/testdata/sf{sf}').count()} rows only", None
        except Exception as e:  # noqa: BLE001
            msg, n = f"{type(e).__name__}: {str(e)[:350]}", ""
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {time.time() - t:.1f}s {n}", flush=True)
        if msg:
            bad.append(name)
            print("   ", msg, flush=True)
    print(f"{len(bad)} failed: {bad}")
