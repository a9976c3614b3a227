"""Compares a query's rows with DuckDB's for the same tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path = path if os.path.isfile(path) else f"{path}/*.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(value):
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(columns)
    return sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)


def same(spark_df, db: duckdb.DuckDBPyConnection, sql: str) -> None:
    told = db.execute(sql)
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(spark_df.columns)
    want = rows_of(names, told.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    assert len(got) == len(want)
    assert got == want
