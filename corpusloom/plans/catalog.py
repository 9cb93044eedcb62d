"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, then: Callable[[DataFrame], DataFrame] | None = None):
    """Register a query under a name, with its SQL; then is applied to its result, to round what engines sum in other orders."""

    def keep(f):
        QUERIES[name] = f if then is None else lambda spark, sf: then(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return keep


def _load() -> None:
    for module in ("corpus", "tokenizer", "retrieval", "benchmark", "sources", "streams"):
        import_module(f"corpusloom.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
