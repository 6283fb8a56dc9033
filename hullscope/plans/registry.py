"""Named queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Registers fn(spark, sf_dir) as name, with SQL in which {view} stands for a derived view's subquery."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            from .views import SQL

            text = sql
            for k, v in SQL.items():
                text = text.replace("{" + k + "}", f"({v})")
            ORACLES[name] = text
        return fn

    return add
