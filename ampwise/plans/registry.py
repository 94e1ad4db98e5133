"""Queries by name, each with its check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run

    return register


def r6(column: str | Column, name: str | None = None) -> Column:
    """Six decimals, so that summation order cannot show."""
    rounded = F.round(F.col(column) if isinstance(column, str) else column, 6)
    return rounded.alias(name or column if isinstance(column, str) else name)
