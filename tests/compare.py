"""Runs a query and its SQL over the same tables and compares rows by column name."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}")
    return v


def rows(spark, con, query, sql, sf):
    got = query(spark, sf)
    cols = sorted(got.columns)
    want = con.sql(sql)
    assert cols == sorted(want.columns), (cols, sorted(want.columns))
    order = ", ".join(f'"{c}"' for c in cols)
    key = lambda r: tuple(map(repr, r))
    left = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key)
    right = sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {order} FROM ({sql})").fetchall()), key=key)
    return left, right
