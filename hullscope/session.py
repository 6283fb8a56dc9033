"""Session defaults for local use; on a cluster the submitted configuration wins."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "hullscope", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
