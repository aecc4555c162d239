"""Run registered queries next to their SQL in DuckDB and compare every value.

usage: python tools/check.py SF PREFIX [PREFIX ...]     (no prefix: all)
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
from tapeloom.plans.registry import all_queries  # noqa: E402
from tapeloom.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in rows)), [cols[i] for i in order]


def main() -> None:
    sf, prefixes = sys.argv[1], sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    bad = []
    for key, q in all_queries().items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, d)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if q.sql is None:
                print(f"ROWS {key}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
                continue
            cur = con.execute(q.oracle())
            cols = [c[0] for c in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            a, ca = canon(got, df.columns)
            b, cb = canon(want, cols)
            if ca != cb:
                status = f"COLUMNS {ca} {cb}"
            elif a == b:
                status = "ok"
            else:
                sa, sb = set(a), set(b)
                only_a, only_b = sorted(sa - sb), sorted(sb - sa)
                status = f"DIFF spark={len(a)} sql={len(b)} only_spark={len(only_a)} only_sql={len(only_b)}\n   {ca}\n   {only_a[:3]}\n   {only_b[:3]}"
            if status != "ok" or not a:
                bad.append(key)
            print(f"{key}: {status} rows={len(a)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(key)
            print(f"{key}: ERROR {type(e).__name__} {str(e)[:700]}", flush=True)
    print("BAD:", bad)


main()
