"""Spark result vs DuckDB oracle, compared the way the driver does it:
row count, column names, and an order-insensitive multiset of values.

Run as a script to check every registered query:
    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
       "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v.to_integral_value() else str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in RAW:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(keyed, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sc, sv = canon(scols, srows)
    dc, dv = canon(dcols, drows)
    ok = sc == dc and sv == dv
    info = {"name": name, "ok": ok, "spark_rows": len(sv), "oracle_rows": len(dv), "sec": round(t1 - t0, 2)}
    if not ok:
        info["cols"] = (sc, dc) if sc != dc else None
        diff_s = [r for r in sv if r not in set(dv)][:3]
        diff_d = [r for r in dv if r not in set(sv)][:3]
        info["only_spark"], info["only_oracle"] = diff_s, diff_d
    return info


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from ledgerline.session import get_spark
    spark = get_spark(cores=8, shuffle_partitions=8)
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in oracle:
            n = fn(spark, sf_dir).count()
            print({"name": name, "rows_only": n})
            continue
        try:
            info = compare(spark, con, name, fn, oracle[name], sf_dir)
        except Exception as e:  # report and continue
            info = {"name": name, "ok": False, "error": repr(e)[:800]}
        bad += not info.get("ok")
        print(info, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
