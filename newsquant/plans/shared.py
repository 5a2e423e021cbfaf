"""Intermediate tables that several parts of one query read: built and written once for that query."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..sources import files

Query = Callable[[SparkSession, str], DataFrame]
_held: ContextVar[dict | None] = ContextVar("held", default=None)


def once(build):
    """``build(spark, sf_dir, ...)`` whose table is written at its first use in a query; further uses read it."""

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str, *args) -> DataFrame:
        held = _held.get()
        if held is None:
            return build(spark, sf_dir, *args)
        key = (build, sf_dir, args)
        if key not in held:
            held[key] = files.saved(build(spark, sf_dir, *args), build.__name__.strip("_"))
        return held[key]

    return run


def query(build: Query) -> Query:
    """``build`` with tables of its own: no query reads what another has written."""

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = _held.set({})
        try:
            return build(spark, sf_dir)
        finally:
            _held.reset(before)

    return run
