"""Event streams: windowed counts with late data, sessions, rates, and keyed state with timers.

The same functions take a batch table or a stream; the watermark only matters for a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, ddl: str, files: int = 10) -> DataFrame:
    """A folder of Parquet files as a stream, so many new files a trigger."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files).parquet(path)


def instants(events: DataFrame, column: str = "ts") -> DataFrame:
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "2 hours", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by window and keys; rows later than the watermark are dropped on a stream."""
    rows = instants(events)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", every), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, length: str = "6 hours", step: str = "3 hours", late: str = "6 hours") -> DataFrame:
    rows = instants(events)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", length, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's activity without a pause of the gap or more."""
    rows = instants(events)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once, within the watermark on a stream."""
    rows = instants(events)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def rate(history: DataFrame, key: str, at: str, count: str, points: int = 8, least_seconds: int | None = 60) -> DataFrame:
    """By key, from the last few points: change a minute between the first and the last of them that have instant and count,
    never below 0. Of the points of one instant the largest count goes. Null under least_seconds; without (None) the change over
    the whole seconds between, however few: over none infinity, or NaN if the count stays, and 0 if no point has both."""
    last = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(count).desc())
    few = history.select(key, at, count, F.row_number().over(last).alias("rn")).where(F.col("rn") <= points)  # cut in each task before the shuffle
    both = F.col(at).isNotNull() & F.col(count).isNotNull()
    span: Column = F.unix_seconds(F.max(at)) - F.unix_seconds(F.min(at))
    gain = F.max_by(count, F.when(both, F.struct(at, -F.col("rn")))) - F.min_by(count, F.when(both, F.struct(at, "rn")))
    rows = few.groupBy(key).agg(span.alias("span"), gain.alias("gain"))
    by_zero = F.col("gain") * F.lit(float("inf"))  # what a division by 0 gives where it doesn't raise
    change = F.greatest(F.lit(0.0), F.when(F.col("span") == 0, by_zero).otherwise(F.col("gain") * 60.0 / F.col("span")))
    return rows.select(key, (change if least_seconds is None else F.when(F.col("span") >= least_seconds, change)).alias("per_minute"))


def leases(changes: DataFrame, lease_seconds: int = 600) -> DataFrame:
    """A stream of (image, worker, kind: claim, beat or done, ts) to (image, state, worker): a running image whose last sign of
    life is older than the lease is reported stale once. State is one small row an image, dropped when the image is done."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        worker, seen = state.get if state.exists else ("", 0.0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"image": [key[0]], "state": ["stale"], "worker": [worker]})
            return
        kind = None
        for b in batches:
            b = b.sort_values("ts")
            kind, worker, seen = b["kind"].iloc[-1], b["worker"].iloc[-1], max(seen, b["ts"].iloc[-1].timestamp())
        if kind == "done":
            if state.exists:
                state.remove()
        else:
            state.update((worker, seen))
            state.setTimeoutTimestamp(max(int((seen + lease_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"image": [key[0]], "state": ["done" if kind == "done" else "running"], "worker": [worker]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return changes.withWatermark("ts", "1 minute").groupBy("image").applyInPandasWithState(step, "image string, state string, worker string", "worker string, seen double", "append", GroupStateTimeout.EventTimeTimeout)


def into_table(stream: DataFrame, path: str, checkpoint: str):
    """Appends what is new and ends: progress is in the checkpoint, so a rerun goes on where this one stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
