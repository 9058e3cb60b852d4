"""Runs a registered query on Spark and its SQL in DuckDB, and compares the rows.

    python -m tests.oracle [-d sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else round(v, 9)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    t2 = time.time()
    note = f"rows {sum(got.values())}/{sum(want.values())} spark {t1 - t0:.2f}s duck {t2 - t1:.2f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"{note} columns {sorted(df.columns)} / {sorted(names)}"
    if got != want:
        extra, missing = got - want, want - got
        note += f" differ {sum(extra.values())}\n   spark  {str(next(iter(extra), None))[:600]}\n   oracle {str(next(iter(missing), None))[:600]}"
    return got == want, note


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from matchloom.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["-d"]:
        sf_dir, argv = argv[1], argv[2:]
    spark = local_session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(sf_dir)
    bad = 0
    for name in argv or list(queries):
        try:
            if name in oracles:
                ok, note = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                t0 = time.time()
                n = len(queries[name](spark, sf_dir).collect())
                ok, note = n > 0, f"rows {n} spark {time.time() - t0:.2f}s (no SQL)"
        except Exception as e:  # keep going: one report for all names
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
