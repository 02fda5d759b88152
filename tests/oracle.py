"""Runs a query in Spark and its SQL in DuckDB on the same tables."""

import os

import duckdb


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(repr, frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None)))


def same(spark, sf_dir, fn, sql):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    got, want = rows(fn(spark, sf_dir).toPandas()), rows(con.sql(sql).df())
    assert got == want
