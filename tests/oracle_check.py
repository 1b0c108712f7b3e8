"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [query ...]

Rows are compared as multisets after sorting columns by name; doubles are
rounded to 9 significant digits, so only representation noise is ignored.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if getattr(v, "tzinfo", None) else v.isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    report = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            scols = sdf.columns
            srecs = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # report and continue
            report[name] = ("spark-error", str(e)[:400])
            if verbose:
                print(name, "SPARK ERROR", str(e)[:400], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            report[name] = ("rows-only", len(srecs))
            if verbose:
                print(f"{name}: rows-only {len(srecs)} ({ts:.1f}s)", flush=True)
            continue
        try:
            res = con.execute(sqls[name])
            dcols = [c[0] for c in res.description]
            drecs = res.fetchall()
        except Exception as e:
            report[name] = ("sql-error", str(e)[:400])
            if verbose:
                print(name, "SQL ERROR", str(e)[:400], flush=True)
            continue
        same_cols = sorted(scols) == sorted(dcols)
        a, b = rows_of(scols, srecs), rows_of(dcols, drecs)
        ok = same_cols and a == b
        report[name] = ("match" if ok else "MISMATCH", len(srecs), len(drecs))
        if verbose:
            print(
                f"{name}: {'match' if ok else 'MISMATCH'} spark={len(srecs)} duck={len(drecs)} "
                f"cols={'ok' if same_cols else (sorted(scols), sorted(dcols))} ({ts:.1f}s)",
                flush=True,
            )
            if same_cols and not ok:
                sa, sb = set(a), set(b)
                only_s = [r for r in a if r not in sb][:3]
                only_d = [r for r in b if r not in sa][:3]
                print("   spark-only:", [tuple(str(x)[:120] for x in r) for r in only_s])
                print("   duck-only: ", [tuple(str(x)[:120] for x in r) for r in only_d])
    return report


if __name__ == "__main__":
    from guardspark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session()
    rep = compare(spark, sf, names)
    bad = [k for k, v in rep.items() if v[0] not in ("match", "rows-only")]
    print("BAD:", bad)
