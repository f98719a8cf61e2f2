"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def r6(col: Column | str, name: str) -> Column:
    """Rounded as both engines are compared; adding zero turns a negative zero into zero."""
    return (F.round(F.col(col) if isinstance(col, str) else col, 6) + F.lit(0.0)).alias(name)


def joined(values: Column, name: str) -> Column:
    """An array of numbers as one text of millionths, so that arrays compare as plain columns."""
    return F.array_join(
        F.transform(values, lambda v: F.round(v * 1e6).cast("bigint").cast("string")), ",", "null"
    ).alias(name)
