"""Run registered queries and their SQL on the same tables and compare the rows.

    python -m verification.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

from . import load_all
from .registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


SQL_TYPES = {"integer": "int", "varchar": "string", "number": "double"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.12g}"
    return repr(v)


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(name: str, spark, con, sf: str) -> tuple[bool, str]:
    t0 = time.time()
    df = QUERIES[name](spark, sf)
    got = canonical(df.columns, [tuple(x) for x in df.collect()])
    t1 = time.time()
    if name not in ORACLES:
        return len(got) > 0, f"{len(got)} rows, no SQL, {t1 - t0:.1f}s"
    res = con.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    want = canonical(cols, res.fetchall())
    t2 = time.time()
    note = f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    theirs = {d[0]: SQL_TYPES.get(str(d[1]).lower(), str(d[1]).lower()) for d in res.description}
    differ = {c: (t, theirs.get(c)) for c, t in df.dtypes if t != theirs.get(c)}
    if differ:
        note += f", types differ {differ}"
    if sorted(cols) != sorted(df.columns):
        return False, f"{note}: columns {sorted(df.columns)} vs {sorted(cols)}"
    if not got:
        return False, f"{note}: empty"
    if got != want:
        extra = [x for x in got if x not in set(want)][:3]
        lost = [x for x in want if x not in set(got)][:3]
        return False, f"{note}: {len(want)} wanted; only spark {extra}; only sql {lost}"
    return True, note


def main() -> int:
    from swardshift import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    load_all()
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in args.names or list(QUERIES):
        try:
            ok, note = compare(name, spark, con, args.sf)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + f"{name}: {note}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
