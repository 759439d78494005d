"""Where queries are registered, each with the SQL that it is checked against, if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLE_SQL[key] = sql
        return function

    return register


def values_sql(rows: list[tuple], names: str) -> str:
    """A query that returns the given rows: what an operator must give for seeded input."""

    def show(x: object) -> str:
        return "NULL" if x is None else f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else str(x)

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") v({names})"
