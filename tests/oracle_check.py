"""Run registered Spark queries and their DuckDB oracle side by side and compare (rows, column names, values).

Usable from pytest (``compare_key``) and as a script: ``python tests/oracle_check.py [sf_dir] [key ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

RAW = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
       "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in RAW:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare_key(spark, con, queries, oracle, key, sf_dir):
    t0 = time.time()
    sdf = queries[key](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.execute(oracle[key])
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    t2 = time.time()
    res = {"key": key, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "cols_match": sorted(s_cols) == sorted(d_cols), "spark_s": round(t1 - t0, 2), "oracle_s": round(t2 - t1, 2)}
    res["values_match"] = res["cols_match"] and _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
    if not res["cols_match"]:
        res["spark_cols"], res["oracle_cols"] = sorted(s_cols), sorted(d_cols)
    elif not res["values_match"]:
        a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
        res["only_spark"] = [r for r in a if r not in b][:3]
        res["only_oracle"] = [r for r in b if r not in a][:3]
    return res


def main(argv):
    stored = "--stored" in argv
    argv = [a for a in argv if a != "--stored"]
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    from convops.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", 8)
    if stored:  # run every query over a stored copy of the platform tables instead of the views
        import tempfile
        from convops.sources.binding import bind, register_materialized
        from convops.sources.store import materialize
        platform_dir = os.path.join(tempfile.mkdtemp(prefix="convops-platform-"), "platform")
        materialize(bind(spark, sf_dir), platform_dir)
        register_materialized(sf_dir, platform_dir)
    con = duck(sf_dir)
    queries, oracle = E.queries(), E.oracle_sql()
    keys = keys or list(queries)
    bad = 0
    for k in keys:
        if k not in oracle:
            df = queries[k](spark, sf_dir)
            print({"key": k, "spark_rows": df.count(), "oracle": "none"})
            continue
        try:
            r = compare_key(spark, con, queries, oracle, k, sf_dir)
        except Exception as e:  # report and continue
            r = {"key": k, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        ok = r.get("values_match") and r.get("spark_rows") == r.get("oracle_rows")
        bad += 0 if ok else 1
        print(("OK   " if ok else "FAIL ") + str(r), flush=True)
    print(f"{len(keys) - bad}/{len(keys)} match")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
