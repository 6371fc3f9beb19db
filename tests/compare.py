"""Run registered queries in Spark and their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def key(row):
    return tuple((v is None, str(type(v).__name__) if not isinstance(v, (int, float)) else "n", v if v is not None else 0) for v in row)


KIND = {
    "bigint": "int", "int": "int", "smallint": "int", "double": "float", "string": "str", "date": "date", "boolean": "bool",
    "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "DATE": "date", "BOOLEAN": "bool", "HUGEINT": "huge",
}


def compare(df, con, sql: str) -> str:
    cols = sorted(df.columns)
    kinds = {f.name: KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    rel = con.sql(sql)
    theirs = {c: KIND.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    if sorted(theirs) != cols:
        return f"columns {cols} != {sorted(theirs)}"
    bad = {c: (kinds[c], theirs[c]) for c in cols if kinds[c] != theirs[c]}
    if bad:
        return f"types {bad}"
    a = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    i = [rel.columns.index(c) for c in cols]
    b = sorted((tuple(norm(r[j]) for j in i) for r in rel.fetchall()), key=key)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if not a:
        return "EMPTY"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    close = [
        1
        for x, y in wrong
        if all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6) for p, q in zip(x, y))
    ]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ ({len(close)} within 2e-6): {cols} {wrong[0]}"
    return f"ok {len(a)}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from peerlens.session import build_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = build_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not sys.argv[1:] or any(a in n for a in sys.argv[1:])]
    failed = 0
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf)
            res = compare(df, con, sqls[n]) if n in sqls else f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {type(e).__name__} {str(e)[:1500]}"
        ok = res.startswith(("ok", "rows ")) and "!=" not in res
        failed += not ok
        print(f"{'' if ok else '!! '}{n}: {res} [{time.time() - t:.1f}s]", flush=True)
    print("failed", failed, "of", len(names))
