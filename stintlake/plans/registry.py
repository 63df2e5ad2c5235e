"""Registered queries: each has a Spark plan and, where SQL can say it, the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stintlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(*tables: str, sql: str | None = None, name: str | None = None):
    """Register a function of DataFrames under its name, or another."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(*(table(spark, folder, t) for t in tables))
        QUERIES[key].__doc__ = f.__doc__
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register
