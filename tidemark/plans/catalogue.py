"""All queries of the library by name. Each module listed has QUERIES: name to (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("vintages", "series", "models", "provider", "streams", "cycles", "walkforward", "evidence", "exchange", "uncertainty", "live", "forms", "diagnosis")


def _all() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for module in MODULES:
        found |= import_module(f"{__package__}.{module}").QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
