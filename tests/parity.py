"""Compare registered queries with their DuckDB counterparts: python tests/parity.py [name or prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(cols, rows):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in at) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark_rows, sql_rows, cols, tol=0.0):
    """First difference as text, or None."""
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} vs {len(sql_rows)}"
    bad = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    if not bad:
        return None
    a, b = bad[0]
    diff = [(c, x, y) for c, x, y in zip(sorted(cols), a, b) if x != y]
    return f"{len(bad)} of {len(spark_rows)} rows differ, first {diff[:4]} in {a[:6]}"


def check(spark, con, name, folder):
    from barloom.catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, folder)
    cols = df.columns
    got = rows_of(cols, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return len(got), None if got else "no rows"
    cur = con.execute(ORACLES[name])
    want_cols = [d[0] for d in cur.description]
    if sorted(cols) != sorted(want_cols):
        return len(got), f"columns {sorted(cols)} vs {sorted(want_cols)}"
    return len(got), compare(got, rows_of(want_cols, cur.fetchall()), cols)


def main(args):
    from barloom import build_session
    from barloom.catalog import ORACLES, QUERIES

    folder = "/root/testdata/sf0.01"
    if args and args[0].startswith("sf"):
        folder = f"/root/testdata/{args.pop(0)}"
    spark = build_session("parity", "8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    for pair in os.environ.get("PARITY_CONF", "").split(","):
        if "=" in pair:
            spark.conf.set(*pair.split("=", 1))
    con = duck(folder)
    wanted = [n for n in QUERIES if not args or any(n.startswith(a) for a in args)]
    failed = []
    for n in wanted:
        start = time.time()
        try:
            count, problem = check(spark, con, n, folder)
        except Exception as e:  # noqa: BLE001
            count, problem = 0, f"{type(e).__name__}: {str(e)[:700]}"
        if problem or count == 0:
            failed.append(n)
        mark = "ok  " if not problem else "FAIL"
        print(f"{mark} {n:8s} {count:7d} rows {time.time() - start:5.1f}s {'' if n in ORACLES else '(rows only) '}{problem or ''}", flush=True)
    print(f"{len(wanted) - len(failed)}/{len(wanted)} good; failed: {' '.join(failed)}")


if __name__ == "__main__":
    main(sys.argv[1:])
