"""Derived tables follow their inputs."""

from pyspark.sql import functions as F

from hullscope.operators.snapshots import fresh


def test_built_once_and_again_after_a_change(spark, tmp_path):
    at, calls = str(tmp_path / "t"), []

    def build():
        calls.append(1)
        return spark.read.parquet(at).agg(F.sum("id").alias("n"))

    spark.range(5).write.parquet(at)
    assert [fresh(spark, "sums", [at], build).first()["n"] for _ in range(2)] == [10, 10] and len(calls) == 1
    spark.range(7).write.mode("append").parquet(at)
    assert fresh(spark, "sums", [at], build).first()["n"] == 31 and len(calls) == 2
