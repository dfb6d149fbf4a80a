"""Registering queries: a name, a function of (spark, sf_dir), and SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources import adapter

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str | None = None):
    """Registers the decorated function; its SQL comes after the adapter's expressions for ``tables``."""

    def add(f: Callable[..., DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = adapter.with_tables(tables, sql) if tables else sql
        return f

    return add
