"""Derived tables that are built once for a state of their inputs and read until an input changes."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from .checkpoint import shared


def state_of(spark: SparkSession, paths: list[str]) -> str:
    """A hash of the names, lengths and times of the files below the paths, in any store that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen: list[str] = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        found = at.getFileSystem(conf).listFiles(at, True)
        while found.hasNext():
            f = found.next()
            seen.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:32]


def fresh(spark: SparkSession, name: str, paths: list[str], build: Callable[[], DataFrame], code: tuple[ModuleType, ...] = ()) -> DataFrame:
    """build()'s rows as a table in the shared folder, built anew only where none of the inputs' present state is there, nor
    one that the present source of the modules ``code`` made.

    A table counts once its commit is complete; one that was begun and not finished is replaced.
    """
    source = hashlib.sha256("".join(map(inspect.getsource, code)).encode()).hexdigest()[:16]
    path = f"{shared(spark)}/hullscope/views/{name}-{source}-{state_of(spark, paths)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
