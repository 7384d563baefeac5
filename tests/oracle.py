"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        con.execute(f"create view {table} as select * from read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def table(columns: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    """Columns sorted by name, rows sorted as text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted(tuple(_cell(row[i]) for i in order) for row in rows),
    )


def spark_table(df):
    return table(df.columns, df.collect())


def duck_table(con, sql: str):
    result = con.execute(sql)
    return table([c[0] for c in result.description], result.fetchall())
