"""All queries of the engine by name, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

MODULES = ("temporal", "catalog", "ranking", "review", "dedup", "text", "vector", "graph", "regulation", "spatial", "diff", "streaming", "search", "knowledge", "records", "linked", "files")


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"quarry.plans.{name}")
