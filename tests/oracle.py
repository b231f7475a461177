"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares the rows."""

import decimal
import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(d: str = DATA):
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        files = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{files}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    return str(v) if isinstance(v, list | dict) else v


def _sorted(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def check(spark, query, sql, d: str = DATA):
    df = query(spark, d)
    cols = sorted(df.columns)
    got = _sorted(tuple(r[c] for c in cols) for r in df.collect())
    cur = connect(d).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = _sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    assert len(got) == len(want)
    assert [p for p in zip(got, want) if p[0] != p[1]][:3] == []
