"""Sinks: small JSON artefacts, JSON lines, gzip TSV, CSV metrics, per-target reports, upserts by rewrite, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_artefact(df: DataFrame, path: str) -> None:
    """One JSON file of a small result; the committer renames it into place when it is whole."""
    df.coalesce(1).write.mode("overwrite").json(path)


def json_lines(df: DataFrame, path: str, resume: bool = False) -> None:
    """With resume an existing output is left alone."""
    df.write.mode("ignore" if resume else "overwrite").json(path)


def gzip_tsv(df: DataFrame, path: str, resume: bool = True) -> None:
    df.write.mode("ignore" if resume else "overwrite").option("sep", "\t").option("compression", "gzip").option("quote", "").csv(path)


def csv_metrics(df: DataFrame, path: str, fields: list[str]) -> None:
    """The given fields only, in their order; a missing one is empty."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields)).write.mode("overwrite").option("header", True).csv(path)


def per_target(df: DataFrame, path: str, key: str) -> None:
    """A folder for each key; rows of a key are brought together first, so each folder gets one file."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def table_values(df: DataFrame, key: str, value: str) -> dict[str, str]:
    """A key/value table of a report as a dictionary (small by construction)."""
    return {r[key]: r[value] for r in df.select(key, F.col(value).cast("string").alias(value)).collect()}


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> DataFrame:
    """Next version of a keyed table: old rows without a new one, and the new ones, the last by seq of a key."""
    from pyspark.sql import Window

    last = new.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("seq").desc()))).where("__r = 1").drop("__r", "seq")
    old = spark.read.schema(last.schema).parquet(path)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def snapshot(df: DataFrame, path: str) -> None:
    """A compressed copy before a change; an existing one stays."""
    df.write.mode("ignore").option("compression", "gzip").json(path)
