"""Run registered queries in Spark and their DuckDB oracle side by side.

    python tests/oracle_check.py [sf_dir] [name ...]

Compares column names, row counts and the multiset of rows (order-insensitive).
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

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, name, sf_dir, query, sql):
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = rows_of(s_cols, [tuple(r) for r in sdf.collect()])
    t1 = time.time()
    rel = con.sql(sql)
    o_cols = rel.columns
    o_rows = rows_of(o_cols, rel.fetchall())
    t2 = time.time()
    problems = []
    if sorted(s_cols) != sorted(o_cols):
        problems.append(f"columns spark={sorted(s_cols)} oracle={sorted(o_cols)}")
    if len(s_rows) != len(o_rows):
        problems.append(f"rows spark={len(s_rows)} oracle={len(o_rows)}")
    if not problems and s_rows != o_rows:
        diff = [(a, b) for a, b in zip(s_rows, o_rows) if a != b][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems, len(s_rows), t1 - t0, t2 - t1


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from gleaner.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        if name not in sqls:
            n = qs[name](spark, sf_dir).count()
            print(f"{name:28s} rows-only  rows={n}")
            continue
        try:
            problems, n, ts, to = compare(spark, con, name, sf_dir, qs[name], sqls[name])
        except Exception as exc:  # noqa: BLE001
            problems, n, ts, to = [f"error: {type(exc).__name__}: {str(exc)[:400]}"], -1, 0, 0
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{name:28s} {status} rows={n} spark={ts:.1f}s duck={to:.1f}s {'; '.join(problems)[:1500]}")
    print(f"{bad} mismatching")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
