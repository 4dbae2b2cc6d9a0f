"""Run registered queries in Spark and their oracle SQL in DuckDB and compare
them the way the driver does: columns sorted by name, floats rounded to 6
places, order-insensitive multiset of rows.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(_norm(r[i]) for i in order) for r in records], [cols[i] for i in order]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def check(spark, names, sf_dir, verbose=True, plans=None):
    """``plans`` receives the queries' physical plans by name."""
    import __spark_entry__ as e
    qs, sqls = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for n in names:
        t0 = time.time()
        df = qs[n](spark, sf_dir)
        if plans is not None:
            plans[n] = df._jdf.queryExecution().executedPlan().toString()
        s_cols = df.columns
        s_recs = [tuple(r) for r in df.collect()]
        t1 = time.time()
        if n not in sqls:
            out[n] = ("rows-only", len(s_recs))
            if verbose:
                print(f"{n:28s} rows-only rows={len(s_recs)} spark={t1 - t0:.1f}s", flush=True)
            continue
        cur = con.execute(sqls[n])
        d_cols = [c[0] for c in cur.description]
        d_recs = cur.fetchall()
        t2 = time.time()
        a, ac = rows_of(s_cols, s_recs)
        b, bc = rows_of(d_cols, d_recs)
        ok = ac == bc and Counter(a) == Counter(b)
        out[n] = ok
        if verbose:
            print(f"{n:28s} {'OK ' if ok else 'BAD'} spark={len(a)} duck={len(b)} "
                  f"cols_equal={ac == bc} spark_t={t1 - t0:.1f}s duck_t={t2 - t1:.1f}s", flush=True)
            if not ok:
                if ac != bc:
                    print("   spark cols", ac, "\n   duck cols ", bc)
                ca, cb = Counter(a), Counter(b)
                print("   only spark:", list((ca - cb).elements())[:3])
                print("   only duck: ", list((cb - ca).elements())[:3])
    return out


if __name__ == "__main__":
    from quarry.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session(shuffle_partitions=8)
    import __spark_entry__ as e
    names = sys.argv[2:] or list(e.queries())
    res = check(spark, names, sf)
    bad = [k for k, v in res.items() if v is False]
    print("BAD:", bad)
