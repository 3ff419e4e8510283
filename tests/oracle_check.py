"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Mimics the driver: row count, column names, order-insensitive values
(floats rounded to 6 digits).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm(v.item())
        except Exception:
            pass
    return v


def rows_key(rows):
    return sorted((tuple(norm(x) for x in r) for r in rows), key=lambda t: repr(t))


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, key, fn, sql, sf_dir, con):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    ts = time.time() - t0
    if sql is None:
        return dict(key=key, ok=None, rows=len(srows), spark_s=round(ts, 2))
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    td = time.time() - t1
    order_s = sorted(range(len(cols)), key=lambda i: cols[i])
    order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
    same_cols = sorted(cols) == sorted(dcols)
    a = rows_key([tuple(r[i] for i in order_s) for r in srows])
    b = rows_key([tuple(r[i] for i in order_d) for r in drows])
    ok = same_cols and len(a) == len(b) and a == b
    out = dict(key=key, ok=ok, rows=len(srows), oracle_rows=len(drows), spark_s=round(ts, 2),
               duck_s=round(td, 2))
    if not same_cols:
        out["cols"] = (sorted(cols), sorted(dcols))
    elif not ok:
        sa, sb = set(a), set(b)
        diff = [x for x in a if x not in sb][:3]
        diff2 = [x for x in b if x not in sa][:3]
        out["spark_only"] = diff
        out["oracle_only"] = diff2
    return out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    from tallyspark.session import get_spark
    import __spark_entry__ as E
    spark = get_spark("local[8]", 8)
    qs = E.queries()
    sqls = E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for k in (keys or list(qs)):
        try:
            r = compare(spark, k, qs[k], sqls.get(k), sf_dir, con)
        except Exception as e:  # report and continue
            r = dict(key=k, ok=False, error=f"{type(e).__name__}: {str(e)[:400]}")
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"DONE bad={bad}")


if __name__ == "__main__":
    main()
