"""Rows of a Spark query against its SQL in DuckDB, order left aside."""

import math
import os
from collections import Counter

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def connect(d):
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f[:-8]} as select * from '{d}/{f}'")
    return con


def assert_same(df, con, sql):
    cols = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
