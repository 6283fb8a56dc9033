"""Cutting lineage: a table in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the cluster's; a local session gets its own where none is set."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="hullscope-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def kept(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written once as Parquet and read back."""
    path = f"{shared(df.sparkSession)}/hullscope/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
