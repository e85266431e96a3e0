"""Run queries against their SQL twins and report differences.

    python tools/check_twins.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from importlib import import_module
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from quire.plans.registry import MODULES  # noqa: E402
from quire.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
    return str(v)


def compare(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    expected = cur.fetchall()
    got = df.collect()
    order = sorted(names)
    if sorted(df.columns) != order:
        return f"columns {sorted(df.columns)} != {order}", len(got)
    a = sorted(tuple(cell(r[c]) for c in order) for r in got)
    at = [names.index(c) for c in order]
    b = sorted(tuple(cell(r[i]) for i in at) for r in expected)
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    off = [f"{n}: {t}/{types[n]}" for n, t in df.dtypes if kinds.get(t) != types[n].upper().replace("STRING", "VARCHAR").replace("BOOL", "BOOLEAN").replace("BOOLEANEAN", "BOOLEAN")]
    note = f" types {off}" if off else ""
    if a != b:
        only_a, only_b = set(a) - set(b), set(b) - set(a)
        return (
            f"rows {len(a)} vs {len(b)}; only spark {len(only_a)}: {[tuple(x[:120] for x in r) for r in sorted(only_a)[:2]]}; "
            f"only sql {len(only_b)}: {[tuple(x[:120] for x in r) for r in sorted(only_b)[:2]]}{note}"
        ), len(a)
    return note, len(a)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module", action="append")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for module in args.module or MODULES:
        for name, (fn, sql) in import_module(f"quire.plans.{module}").registry.entries.items():
            if args.names and name not in args.names:
                continue
            start = time.time()
            try:
                df = fn(spark, args.sf)
                if sql is None:
                    rows = len(df.collect())
                    print(f"rows  {name:32s} {rows:8d} {time.time() - start:6.2f}s", flush=True)
                    continue
                message, rows = compare(df, con, sql)
            except Exception as e:  # noqa: BLE001
                message, rows = f"{type(e).__name__}: {str(e)[:700]}", -1
            bad += bool(message)
            print(f"{'DIFF ' if message else 'ok   '} {name:32s} {rows:8d} {time.time() - start:6.2f}s {message}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
