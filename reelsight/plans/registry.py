"""Registry of named queries and their oracle SQL.

Each query is a function ``(spark, sf_dir) -> DataFrame`` that reads the
driver's tables (or tables Spark derives from them).  A query that SQL can
express registers its DuckDB oracle next to it; ML and streaming queries
register none and are checked by the test suite instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add ``fn`` under ``name``; ``sql`` is its oracle, if any."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from reelsight.plans import (eda_queries, join_queries, genre_queries,  # noqa: F401
                                 source_queries, model_queries, serving_queries)
