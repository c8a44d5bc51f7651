"""Runs a query and its SQL over the same tables and compares rows by column name."""

import duckdb


def frames(spark, name, queries, sql, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries[name](spark, sf)
    want = con.sql(sql[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = ", ".join(f'"{c}"' for c in cols)
    return sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))), sorted(map(repr, con.sql(f"SELECT {order} FROM ({sql[name]})").fetchall()))
