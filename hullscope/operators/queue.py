"""The work queue as state transitions over a jobs table: every operation takes the table and returns its next state.

Parquet has no row updates, so a caller writes the returned table as the next version; one writer at a time. Jobs have
the columns of ``schemas.JOB``; times are epoch seconds, given by the caller (never now()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "running", "done", "failed", "skipped")


def changed(jobs: DataFrame, when: Column, **values: Column) -> DataFrame:
    return jobs.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def seed(jobs: DataFrame, targets: DataFrame, now: float) -> DataFrame:
    """Targets that aren't queued come in as pending, the first by seq of an image; queued ones stay as they are."""
    from pyspark.sql import Window

    new = targets.withColumn("rn", F.row_number().over(Window.partitionBy("image").orderBy("seq"))).where("rn = 1").join(jobs.select("image"), "image", "left_anti")
    start = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    from .stats import ranked

    rows = ranked(new, [F.col("seq"), F.col("image")])
    none = lambda kind: F.lit(None).cast(kind)
    rows = rows.select(
        (F.lit(start) + F.col("pos") + 1).alias("id"), "image", F.coalesce("name", "image").alias("name"), none("string").alias("target_json"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.lit("pending").alias("status"), none("string").alias("worker_id"),
        F.lit(0).alias("attempts"), none("string").alias("error"), F.lit(now).alias("created_at"), none("double").alias("started_at"), none("double").alias("heartbeat_at"), none("double").alias("finished_at"),
    )
    return jobs.unionByName(rows)


def next_pending(jobs: DataFrame, count: int) -> DataFrame:
    """The jobs that would be claimed: weight, then least id."""
    return jobs.where("status = 'pending'").orderBy(F.col("weight").desc(), "id").limit(count)


def claim(jobs: DataFrame, worker: str, count: int, now: float) -> DataFrame:
    """count jobs become the worker's; a retried job keeps its first start."""
    chosen = next_pending(jobs, count).select("id", F.lit(True).alias("__mine"))
    rows = jobs.join(F.broadcast(chosen), "id", "left")  # count rows
    mine = F.coalesce("__mine", F.lit(False))
    return changed(rows, mine, status=F.lit("running"), worker_id=F.lit(worker), attempts=F.col("attempts") + 1, started_at=F.coalesce("started_at", F.lit(now)), heartbeat_at=F.lit(now)).drop("__mine").select(*jobs.columns)


def heartbeat(jobs: DataFrame, ids: list[int], now: float) -> DataFrame:
    return changed(jobs, F.col("id").isin(ids) & (F.col("status") == "running"), heartbeat_at=F.lit(now))


def reclaim_stale(jobs: DataFrame, now: float, lease: float) -> DataFrame:
    """Running jobs whose last sign of life (heartbeat, else start) is older than the lease are pending again."""
    stale = (F.col("status") == "running") & (F.coalesce("heartbeat_at", "started_at") < now - lease)
    return changed(jobs, stale, status=F.lit("pending"), worker_id=F.lit(None).cast("string"))


def complete(jobs: DataFrame, ids: list[int], now: float) -> DataFrame:
    return changed(jobs, F.col("id").isin(ids), status=F.lit("done"), finished_at=F.lit(now), error=F.lit(None).cast("string"))


def fail(jobs: DataFrame, ids: list[int] | Column, error: str, now: float, max_attempts: int = 3) -> DataFrame:
    """Pending again while attempts are left, else failed. ids: a list, or a condition where there are many."""
    mine, over = ids if isinstance(ids, Column) else F.col("id").isin(ids), F.col("attempts") >= max_attempts
    return changed(jobs, mine, finished_at=F.when(over, F.lit(now)).otherwise(F.col("finished_at")), error=F.lit(error), worker_id=F.lit(None).cast("string"), status=F.when(over, "failed").otherwise("pending"))


def skip(jobs: DataFrame, ids: list[int], why: str, now: float) -> DataFrame:
    return changed(jobs, F.col("id").isin(ids), status=F.lit("skipped"), error=F.lit(why), finished_at=F.lit(now))


def reset(jobs: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    back = F.col("status").isin(*statuses)
    return changed(jobs, back, status=F.lit("pending"), attempts=F.lit(0), error=F.lit(None).cast("string"), worker_id=F.lit(None).cast("string"))


def upserted(reports: DataFrame, new: DataFrame) -> DataFrame:
    """Reports by image: new rows replace old ones."""
    return reports.join(new.select("image"), "image", "left_anti").unionByName(new)


def merged_passes(prior: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Prior rows of scanners that didn't run now, then the rows of now."""
    return prior.join(now.select(*keys).distinct(), keys, "left_anti").unionByName(now, allowMissingColumns=True)


def reweighted(jobs: DataFrame, ranking: DataFrame) -> DataFrame:
    """Every status gets its image's new weight; images not ranked keep theirs."""
    new = ranking.groupBy("image").agg(F.max("weight").alias("__w"))
    return jobs.join(new, "image", "left").withColumn("weight", F.coalesce("__w", "weight")).select(*jobs.columns)


def trimmed(jobs: DataFrame, keep: int) -> DataFrame:
    """Pending jobs strictly below the weight of the keep-th pending job go; ties with it stay."""
    pending = jobs.where("status = 'pending'").select("weight")
    # the threshold comes from weight counts, a row a distinct weight
    weights = pending.groupBy("weight").agg(F.count(F.lit(1)).alias("n"))
    from .stats import ranked, running_sum

    placed = running_sum(ranked(weights, [F.col("weight").desc()], "p"), "p", "n", "before")
    cut = placed.where((F.col("before") < keep) & (F.col("before") + F.col("n") >= keep)).agg(F.max("weight")).first()[0]
    return jobs if cut is None else jobs.where((F.col("status") != "pending") | (F.col("weight") >= cut))


def preserved(before: DataFrame, after: DataFrame) -> bool:
    """done and running jobs never get fewer."""
    count = lambda df: {r["status"]: r["n"] for r in df.where("status IN ('done', 'running')").groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    old, new = count(before), count(after)
    return all(new.get(k, 0) >= n for k, n in old.items())


def stats(jobs: DataFrame) -> DataFrame:
    """A row for each status, zeros filled in."""
    from .findings import filled_counts

    return filled_counts(jobs, "status", STATUSES)
