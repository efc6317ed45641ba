"""Rows of a Spark query and of its SQL, made comparable."""

import datetime
import decimal

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return str(pd.Timestamp(v))
    if isinstance(v, datetime.date):
        return str(v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def rows_of_sql(con, sql):
    r = con.sql(sql)
    at = [r.columns.index(c) for c in sorted(r.columns)]
    return sorted(r.columns), sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=lambda r: tuple(map(str, r)))
