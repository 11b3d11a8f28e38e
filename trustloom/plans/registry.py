"""Named queries, the inventory items they answer, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name], COVERS[name] = f, covers
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
