"""Queries of the library's own operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import articles, records, shared, signals, stocks

PLANS = (stocks, articles, records, signals)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shared.query(query) for plan in PLANS for name, query in plan.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.oracle_sql().items()}
