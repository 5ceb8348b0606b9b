"""Run registered queries against their SQL on DuckDB.

    python tests/oracle_check.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame):
    import numpy as np
    import pandas as pd

    frame = frame[sorted(frame.columns)].copy()
    kinds = {}
    rows = []
    for name in frame.columns:
        col = frame[name]
        kind = col.dtype.kind
        kinds[name] = {"u": "i", "M": "time", "U": "O"}.get(kind, kind)
        rows.append([
            None if (v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NaT or v is pd.NA)
            else repr(v.item()) if hasattr(v, "item") else repr(v)
            for v in col.tolist()
        ])
    table = sorted(zip(*rows), key=lambda r: tuple("" if x is None else x for x in r)) if rows else []
    return kinds, table


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    got = fn(spark, folder).toPandas()
    t1 = time.time()
    if sql is None:
        return ("ROWS", f"{len(got)} rows", t1 - t0)
    want = con.execute(sql).df()
    kg, rg = canonical(got)
    kw, rw = canonical(want)
    if list(kg) != list(kw):
        return ("FAIL", f"columns {list(kg)} vs {list(kw)}", t1 - t0)
    bad = {c: (kg[c], kw[c]) for c in kg if kg[c] != kw[c] and len(rg) and not (
        {kg[c], kw[c]} <= {"O", "b", "f", "i"} and any(r[list(kg).index(c)] is None for r in rg))}
    if bad:
        return ("FAIL", f"types {bad}", t1 - t0)
    if len(rg) != len(rw):
        return ("FAIL", f"{len(rg)} rows vs {len(rw)}", t1 - t0)
    diff = [(a, b) for a, b in zip(rg, rw) if a != b]
    if diff:
        cols = list(kg)
        sample = []
        for a, b in diff[:3]:
            sample.append({c: (x, y) for c, x, y in zip(cols, a, b) if x != y})
        return ("FAIL", f"{len(diff)} of {len(rg)} rows differ {sample}", t1 - t0)
    note = " EMPTY" if not rg else ""
    return ("OK", f"{len(rg)} rows{note}", t1 - t0)


def main():
    import __spark_entry__ as entry
    from insightspark.session import build_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    prefixes = args[1:]
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls = entry.oracle_sql()
    tally = {}
    for name, fn in entry.queries().items():
        if prefixes and not any(name == p or name.startswith(p) for p in prefixes):
            continue
        try:
            state, note, secs = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as exc:  # report and go on
            state, note, secs = "ERROR", str(exc).split("JVM stacktrace")[0][:700], 0.0
        tally[state] = tally.get(state, 0) + 1
        print(f"{state:5} {secs:6.2f}s {name} {note}", flush=True)
    print(tally)


if __name__ == "__main__":
    main()
