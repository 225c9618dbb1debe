"""Registry of the core queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that must give the same rows where there is one."""

    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def sql_of(name: str) -> str:
    """The SQL of a query that is already registered."""
    return _SQL[name]


def _load() -> None:
    from escriba.plans import core_queries, source_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
