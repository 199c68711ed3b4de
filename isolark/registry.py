"""Registered queries and, side by side, the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key``; ``sql`` is its DuckDB twin.

    ``sql`` may refer to any bound view of :mod:`isolark.plans.bindings`; the
    definitions are prepended as common table expressions.
    """

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            from isolark.plans.bindings import expand

            ORACLES[key] = expand(sql)
        return fn

    return register
