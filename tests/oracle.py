"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value: object) -> str:
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def agree(spark, query, sql: str, folder: str = DATA) -> int:
    """The number of rows, if both give the same ones in the same columns."""
    got = query(spark, folder)
    names = sorted(got.columns)
    want = duck(folder).sql(sql)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    mine = sorted(tuple(plain(r[n]) for n in names) for r in got.collect())
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert mine == theirs
    return len(mine)
