"""Rows of a Spark query and of its SQL in DuckDB, made comparable: columns by name, values as text, rows sorted."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

from tessera.sources.tables import NAMES


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in NAMES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.6g}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def table(columns: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def both(spark, folder: str, query, sql: str):
    df = query(spark, folder)
    got = table(df.columns, df.collect())
    result = views(folder).execute(sql)
    return got, table([d[0] for d in result.description], result.fetchall())
