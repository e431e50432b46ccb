"""Registry of the named queries exposed through ``__spark_entry__``.

Each query is ``fn(spark, sf_dir) -> DataFrame``; an oracle SQL string for
DuckDB is attached when the operator has an exact SQL definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from tillpoint.plans import charts, cleaning, clustering, forecasting, series, transforms  # noqa: F401
