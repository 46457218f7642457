"""Registration of queries: a function over the tables, and the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quarry.sources.tables import Tables, with_views

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables)`` under ``name``; ``sql`` reads the same tables in DuckDB."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return register
