"""Run registered queries against their DuckDB oracle SQL and compare the results.

Comparison: row count, column names (sorted) and the multiset of rows (values normalised:
timestamps and dates as ISO text, floats rounded).  Usable from pytest and as a script:

    python tests/oracle_compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import collections
import datetime as dt
import decimal
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from lakestar.sources.feed import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, name: str, query, sql: str | None, con=None) -> dict:
    t0 = time.time()
    df = query(spark, sf_dir)
    s_cols = list(df.columns)
    s_rows = [tuple(r) for r in df.collect()]
    t_spark = time.time() - t0
    out = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    out["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        out["status"] = "schema-mismatch"
        out["detail"] = {"spark": sorted(s_cols), "oracle": sorted(d_cols)}
        return out
    sb, db = _bag(s_cols, s_rows), _bag(d_cols, d_rows)
    if sb == db:
        out["status"] = "match"
    else:
        out["status"] = "value-mismatch"
        only_s = list((sb - db).items())[:3]
        only_d = list((db - sb).items())[:3]
        out["detail"] = {"only_spark": only_s, "only_oracle": only_d,
                         "columns": sorted(s_cols)}
    return out


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from lakestar.session import get_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = get_session("local[8]", shuffle_partitions=8)
    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        try:
            res = compare(spark, sf_dir, name, qs[name], sqls.get(name), con)
        except Exception as exc:  # noqa: BLE001
            res = {"name": name, "status": "error", "detail": repr(exc)[:800]}
        if res["status"] not in ("match", "rows-only"):
            bad += 1
        print(res, flush=True)
    print(f"{bad} problems", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
