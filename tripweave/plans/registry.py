"""Collects queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(body: str | None = None, extra: dict[str, str] | None = None):
    """Registers a query under its function name; ``body`` is its check in SQL."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if body is not None:
            ORACLES[fn.__name__] = sql(body, extra)
        return fn
    return add
