"""Run ``queries()`` against ``oracle_sql()`` the way the driver does: row count, column names,
order-insensitive values. Usage: ``python tests/oracle_check.py [sf_dir] [key ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def _rows(cols, tuples):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in tuples]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in RAW:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, keys=None, verbose=True):
    import __spark_entry__ as e
    qs, sqls = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for k in keys or sorted(qs):
        t0 = time.time()
        df = qs[k](spark, sf_dir)
        scols = df.columns
        srows = _rows(scols, [tuple(r) for r in df.collect()])
        t1 = time.time()
        res = {"rows": len(srows), "spark_sec": round(t1 - t0, 2)}
        if k in sqls:
            cur = con.execute(sqls[k])
            dcols = [d[0] for d in cur.description]
            drows = _rows(dcols, cur.fetchall())
            res.update(oracle_rows=len(drows), columns=sorted(scols) == sorted(dcols),
                       values=srows == drows)
            if not res["values"] and verbose:
                print(k, "spark cols", sorted(scols), "duck cols", sorted(dcols))
                sd = set(srows) ^ set(drows)
                for r in list(sd)[:6]:
                    print("  diff", "S" if r in set(srows) else "D", r)
        out[k] = res
        if verbose:
            print(k, res, flush=True)
    return out


if __name__ == "__main__":
    from cobbler.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = build_session(extra={"spark.driver.memory": os.environ.get("ORACLE_DRIVER_MEM", "4g")})
    spark.sparkContext.setLogLevel("ERROR")
    r = compare(spark, sf, keys)
    bad = [k for k, v in r.items() if not v.get("values", True) or not v.get("columns", True)]
    print("MISMATCH:", bad if bad else "none")
