"""Queries by name, each with the SQL it must agree with, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers f(t, spark), t giving a table of the folder by name, under its own name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"), spark)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
