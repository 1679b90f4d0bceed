"""The registered queries of the index operators, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> (query, SQL or None)
_REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(sql: str | None = None):
    """Registers a query under its function's name."""

    def keep(query):
        _REGISTERED[query.__name__] = (query, sql)
        return query

    return keep


def _load() -> None:
    from . import catalogue_queries  # noqa: F401  registers them


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: query for name, (query, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _REGISTERED.items() if sql}
