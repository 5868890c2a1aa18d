"""Runs a query and its SQL twin and compares their rows."""

from __future__ import annotations

import glob
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v) if not hasattr(v, "tzinfo") else v.replace(tzinfo=None).isoformat()

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def twin(sql: str, d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    return cols, cur.fetchall()


def compare(spark, name: str, d: str) -> str:
    """Empty if both agree, else what differs."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, d)
    mine = norm([tuple(r) for r in df.collect()], df.columns)
    cols, rows = twin(e.oracle_sql()[name], d)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    theirs = norm(rows, cols)
    if mine == theirs:
        return ""
    a, b = set(mine), set(theirs)
    return f"{len(mine)} and {len(theirs)} rows; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"


if __name__ == "__main__":
    import time

    import __spark_entry__ as e
    from skytide.session import build_session

    d = sys.argv[1]
    names = sys.argv[2:] or list(e.oracle_sql())
    spark = build_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    for n in names:
        t = time.time()
        try:
            print(n, compare(spark, n, d) or "ok", f"{time.time() - t:.1f} s", flush=True)
        except Exception as x:
            print(n, "FAILED", str(x)[:1500], flush=True)
