"""Compare registered queries with their SQL in DuckDB: check.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tidemark.plans.registry import ALL
from tidemark.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return str(value) if hasattr(value, "isoformat") else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    bad = 0
    for name, (run, sql) in ALL.items():
        if args and name not in args:
            continue
        try:
            t0 = time.time()
            df = run(spark, sf)
            got = table(df.columns, df.collect())
            t1 = time.time()
            if sql is None:
                print(f"rows  {name:24s} {len(got[1]):7d} rows  {t1 - t0:6.2f}s", flush=True)
                continue
            cur = con.execute(sql)
            want = table([c[0] for c in cur.description], cur.fetchall())
            t2 = time.time()
            same = got == want
            print(
                f"{'ok   ' if same else 'DIFF '} {name:24s} {len(got[1]):7d} rows  {t1 - t0:6.2f}s"
                f"  sql {t2 - t1:6.2f}s",
                flush=True,
            )
            if not same:
                bad += 1
                print("   columns", got[0], want[0], "rows", len(got[1]), len(want[1]))
                shown = 0
                for a, b in zip(got[1], want[1]):
                    if a != b and shown < 3:
                        print("   spark", str(a)[:300], "\n   sql  ", str(b)[:300])
                        shown += 1
        except Exception as exc:  # noqa: BLE001 - report and go on
            bad += 1
            print(f"FAIL  {name}: {str(exc)[:1200]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
