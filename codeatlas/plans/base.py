"""The registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str | None = None, sql: str | None = None, recursive: bool = False) -> Callable:
    """Register a function of (spark, sf_dir) by its name, with its SQL over the views named."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = B.sql(views, sql, recursive) if views else sql
        return f

    return add
