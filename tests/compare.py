"""Rows of a query against rows of its SQL in DuckDB."""

import glob
import os

import duckdb


def oracle(sql, sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql).df()


def rows(df, columns):
    t = df[columns].astype(object)
    return sorted(map(repr, t.where(t.notna(), None).itertuples(index=False, name=None)))


def assert_same(df, sql, sf):
    got, want = df.toPandas(), oracle(sql, sf)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
