"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: python tests/harness.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


STRICT = os.environ.get("STRICT") == "1"


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm(v.item())
        except Exception:
            return v
    from decimal import Decimal
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if v is None:
        return None
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, con, sf_dir, key, fn, sql):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if sql is None:
        return dict(key=key, ok=None, rows=len(srows), spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(scols) != sorted(dcols):
        return dict(key=key, ok=False, why=f"cols {sorted(scols)} vs {sorted(dcols)}")
    stypes = {f.name: spark_type(f.dataType) for f in sdf.schema.fields}
    dtypes = {d[0]: duck_type(str(d[1])) for d in res.description}
    tdiff = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
    if len(srows) != len(drows):
        return dict(key=key, ok=False, why=f"rows {len(srows)} vs {len(drows)}")
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return dict(key=key, ok=False, why=f"{len(bad)} value diffs, first {bad[0]}")
    r = dict(key=key, ok=True, rows=len(srows), spark_s=round(t1 - t0, 2))
    if tdiff:
        r["types"] = tdiff
    return r


def spark_type(t):
    n = t.simpleString()
    return {"int": "int32", "bigint": "int64", "double": "double", "string": "str", "date": "date",
            "boolean": "bool", "smallint": "int16", "float": "float", "tinyint": "int8"}.get(n, n)


def duck_type(t):
    t = t.upper()
    if t.startswith("DECIMAL"):
        return t.lower().replace(" ", "")
    return {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "double", "VARCHAR": "str", "DATE": "date",
            "BOOLEAN": "bool", "SMALLINT": "int16", "FLOAT": "float", "HUGEINT": "int128",
            "TINYINT": "int8"}.get(t, t)


def main(argv):
    from labledger.session import get_session
    import __spark_entry__ as E

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:]
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for k, fn in qs.items():
        if keys and k not in keys:
            continue
        try:
            r = compare(spark, con, sf_dir, k, fn, ors.get(k))
        except Exception as e:  # report and continue
            r = dict(key=k, ok=False, why=f"{type(e).__name__}: {str(e)[:300]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print("FAILED", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
