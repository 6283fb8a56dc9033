"""Lookups for a serving layer: weighted full-text search, optional filters, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much a hit in each field counts.
WEIGHTS = {"name": 12, "namespace": 12, "description": 6, "other": 1}


def terms(query: str) -> list[str]:
    """Lower case, runs of letters and digits."""
    clean = "".join(c if c.isalnum() else " " for c in query.lower())
    return list(dict.fromkeys(clean.split()))


def search(rows: DataFrame, query: str, fields: dict[str, int]) -> DataFrame:
    """rows with a score over 0: for each field its weight times the query's terms that are among its words."""
    wanted = terms(query)
    hits = [F.lit(w) * F.size(F.array_intersect(F.split(F.lower(F.coalesce(F.col(f), F.lit(""))), r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, wanted)))) for f, w in fields.items()] if wanted else [F.lit(0)]
    return rows.withColumn("score", reduce(lambda a, b: a + b, hits)).where("score > 0")


def equal_filters(**values: object) -> Column:
    """An AND of equalities; None and empty values don't filter."""
    return reduce(lambda a, b: a & b, (F.col(k) == v for k, v in values.items() if v not in (None, "")), F.lit(True))


def containing(column: str, part: str | None) -> Column:
    """Case-insensitive substring; nothing filters nothing."""
    return F.lower(F.col(column)).contains(part.lower()) if part else F.lit(True)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page number (from 1) of a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def top(rows: DataFrame, key: str, k: int, name: str = "n") -> DataFrame:
    """The k most frequent values, equal counts by value."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), key).limit(k)
