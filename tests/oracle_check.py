"""Run registered Spark queries beside their DuckDB oracle SQL and compare
row count, column names and the order-insensitive multiset of values."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except (ValueError, AttributeError):
            pass
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    try:
        import pandas as pd
        if v is pd.NaT or (not isinstance(v, str) and pd.isna(v)):
            return None
    except (TypeError, ValueError):
        pass
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = True) -> tuple[bool, str]:
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry
    fn = entry.queries()[name]
    sql = entry.oracle_sql().get(name)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if sql is None:
        return True, f"{name}: rows={len(srows)} (no oracle) {t1 - t0:.1f}s"
    con = con or duck(sf_dir)
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    if sorted(scols) != sorted(ocols):
        return False, f"{name}: columns differ spark={sorted(scols)} oracle={sorted(ocols)}"
    if len(srows) != len(orows):
        return False, f"{name}: rows differ spark={len(srows)} oracle={len(orows)}"
    a, b = _rows(scols, srows), _rows(ocols, orows)
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{name}: values differ, e.g. {diffs}"
    return True, f"{name}: ok rows={len(srows)} {t1 - t0:.1f}s"


if __name__ == "__main__":
    sys.path.insert(0, ROOT)
    from valora.session import local_session
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, n, sf, con)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{n}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
