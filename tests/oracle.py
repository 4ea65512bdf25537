"""Spark rows against DuckDB rows of the same Parquet tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def same(df, relation):
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    mine = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*columns).collect())
    at = [relation.columns.index(c) for c in columns]
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
    assert mine == theirs
