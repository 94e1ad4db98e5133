"""Run a query and its check SQL side by side."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    return value


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda row: tuple((v is None, type(v).__name__, str(v)) for v in row))


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, _sorted([tuple(_cell(row[n]) for n in names) for row in df.collect()])


def duck_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, _sorted([tuple(_cell(row[i]) for i in at) for row in cursor.fetchall()])


def difference(df, connection, sql: str) -> str | None:
    names, ours = spark_rows(df)
    other_names, theirs = duck_rows(connection, sql)
    if names != other_names:
        return f"columns {names} vs {other_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            return f"{a} vs {b} in {names}"
    return None
