"""Compares a Spark result with DuckDB's, by columns in order of their names and rows in any order."""

from __future__ import annotations

import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 7) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    cur = con.execute(sql)
    names, kinds = [c[0] for c in cur.description], {c[0]: str(c[1]) for c in cur.description}
    columns = sorted(df.columns)
    assert sorted(names) == columns
    spark_kinds = dict(df.dtypes)
    for c in columns:
        assert TYPES.get(kinds[c], spark_kinds[c]) == spark_kinds[c], c
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want
