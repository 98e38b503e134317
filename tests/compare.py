"""Run registered queries next to their SQL. ``python tests/compare.py SF_DIR [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(0.0 + v) if isinstance(v, float) else repr(v)

    return [columns[i] for i in order], sorted([tuple(cell(r[i]) for i in order) for r in rows])


def compare(spark, con, name, query, sql, sf_dir):
    """Problem text, or None when both sides agree in columns, rows and values."""
    df = query(spark, sf_dir)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    res = con.execute(sql)
    want = normal(res.fetchall(), [c[0] for c in res.description])
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]) or got[1] != want[1]:
        only = [r for r in got[1] if r not in set(want[1])][:3]
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        return f"rows {len(got[1])} / {len(want[1])}; only here {only}; only in SQL {missing}"
    return None if got[1] else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark, con = session(), connect(sf)
    bad = 0
    for n in names:
        t = time.time()
        sql = entry.oracle_sql().get(n)
        try:
            if sql is None:
                problem = None if entry.queries()[n](spark, sf).count() else "no rows"
            else:
                problem = compare(spark, con, n, entry.queries()[n], sql, sf)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{n:32s} {time.time() - t:6.2f}s {'ok' if problem is None else problem}{'' if sql else ' (no SQL)'}", flush=True)
    print(f"{len(names)} queries, {bad} differ")
