"""Runs a query and its SQL on the same tables and compares the rows."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return (0, "")
    return (1, f"{v:.6g}") if isinstance(v, float) else (1, str(v))


def tables(sf=SF):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def check(df, sql, sf=SF):
    cols, got = rows_of(df)
    res = tables(sf).execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in res.fetchall())
    assert got == want
