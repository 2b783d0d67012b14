"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def rounded(col: Column | str) -> Column:
    """Six decimals by the same arithmetic as :func:`sql_rounded`, so both engines agree on ties."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * 1e6 + 0.5) / 1e6


def sql_rounded(expr: str) -> str:
    return f"floor(({expr}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"
