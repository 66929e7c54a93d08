"""Spark result against the DuckDB oracle, the way the driver compares them.

Columns are sorted by name, rows are compared as an order-insensitive
multiset of exact values.  Usable as a script:

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import sys
import time


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (_dt.date, _dt.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare_one(spark, con, name, qfn, sql, sf_dir):
    t0 = time.time()
    df = qfn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    sc, sr = _rows(s_cols, s_rows)
    dc, dr = _rows(d_cols, d_rows)
    ok_cols = sc == dc
    ok_rows = len(sr) == len(dr)
    ok_vals = ok_cols and sr == dr
    detail = ""
    if not ok_cols:
        detail = f"cols spark={sc} duck={dc}"
    elif not ok_vals:
        a, b = set(sr), set(dr)
        detail = f"only_spark={list(a - b)[:3]} only_duck={list(b - a)[:3]}"
    return dict(name=name, cols=ok_cols, rows=ok_rows, values=ok_vals, n_spark=len(sr), n_duck=len(dr),
                spark_sec=round(t1 - t0, 2), detail=detail)


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from revlens.session import local_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session(8)
    con = duck_connect(sf_dir)
    qs = E.queries()
    sqls = E.oracle_sql()
    bad = 0
    for name in (names or sorted(qs)):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            print(f"ROWS-ONLY {name}: {df.count()} rows")
            continue
        try:
            r = compare_one(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as ex:  # report and continue
            bad += 1
            print(f"ERROR {name}: {type(ex).__name__}: {str(ex)[:400]}")
            continue
        flag = "OK " if r["values"] else "BAD"
        bad += 0 if r["values"] else 1
        print(f"{flag} {name}: rows {r['n_spark']}/{r['n_duck']} cols={r['cols']} {r['spark_sec']}s {r['detail']}")
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
