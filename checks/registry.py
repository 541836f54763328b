"""Registered queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import Tables, with_adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(key: str, sql: str | None = None, recursive: bool = False, ctes: str = ""):
    """Register ``fn(tables) -> DataFrame`` under a key, with the SQL it must agree with."""

    def register(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, directory: fn(Tables(spark, directory))
        if sql is not None:
            ORACLES[key] = with_adapters(sql, recursive, ctes)
        return fn

    return register
