"""Percentiles in seven conventions, rank statistics, deciles and histograms.

Conventions differ in which element counts and how ties and rounding go; none stands for another. Rank-based ones number
the rows of each group with a window whose partition is the group; for a global statistic ``ranked`` numbers rows by a
range partition with counts instead, so no single task sorts the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """rows with 0-based positions in the given total order.

    The rows are dealt by range, numbered inside each part, and shifted by the sizes of the parts before. The parts'
    sizes (one row a partition) are the only thing that meets in one task.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # part numbers are monotonic ids of the range partitions: upper bits partition, lower bits place inside it
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    from .checkpoint import kept

    dealt = kept(dealt)
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__before")


def linear_percentile(value: str | Column, q: float) -> Column:
    """Linear interpolation at (n - 1) q, as an aggregate for groups that fit in a task; else ``linear_percentiles``."""
    return F.percentile(value, q)


def true_median(value: str | Column) -> Column:
    return F.percentile(value, 0.5)


#: Rows of a small side that may be broadcast.
BROADCAST_ROWS = 100_000


def checked(few: DataFrame) -> DataFrame:
    """few, broadcast if its counted rows allow it, merged otherwise."""
    return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few.hint("merge")


def ranked_within(rows: DataFrame, keys: list[str], order: list[Column], name: str = "pos", size: str = "size") -> DataFrame:
    """rows with 0-based positions in the given order within each key, and the key's number of rows.

    Dealt by range of key and order, so a key that holds most rows is split like any other stretch; shifted by the counts of
    the key in the parts before: a row for each key of each part is what is joined.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys]
    dealt = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    from .checkpoint import kept

    dealt = kept(dealt)
    w = Window.partitionBy(*keys)
    counts = dealt.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    starts = counts.select(*keys, "__part", "__first", F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__skip"), F.sum("__n").over(w).alias(size))
    starts = kept(starts).toDF(*(f"__k{i}" for i in range(len(keys))), "__p", "__first", "__skip", size)
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col("__part") == F.col("__p"))
    found = dealt.join(checked(starts), on)
    return found.select(*rows.columns, (F.col("__id") - F.col("__first") + F.col("__skip")).alias(name), size)


def linear_percentiles(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linear interpolation at (n - 1) q, by name: of each key the two elements around each place."""
    own = _positions(rows, keys, value)
    at = {k: (F.col("__n") - 1) * F.lit(q) for k, q in qs.items()}
    low, high = {k: F.floor(x) for k, x in at.items()}, {k: F.ceil(x) for k, x in at.items()}
    own = own.where(F.col("__i").isin(*low.values(), *high.values()))
    v = F.col("__v").cast("double")
    pick = lambda when: F.max(F.when(when, v))
    cols = []
    for k, x in at.items():
        a, b, part = pick(F.col("__i") == low[k]), pick(F.col("__i") == high[k]), F.max(x - F.floor(x))
        cols.append((a * (F.lit(1.0) - part) + b * part).alias(k))
    return own.groupBy(*keys).agg(*cols)


def true_medians(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return linear_percentiles(rows, keys, value, {name: 0.5})


def _positions(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    own = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    if not keys:
        return ranked(own, [F.col("__v")], "__i").withColumn("__n", F.lit(own.count()))
    return ranked_within(own, keys, [F.col("__v")], "__i", "__n")


def _element(rows: DataFrame, keys: list[str], value: str, index: Column, name: str) -> DataFrame:
    return _positions(rows, keys, value).where(F.col("__i") == index).select(*keys, F.col("__v").alias(name))


def nearest_rank_percentile(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """The element of rank ceil(q n), 1-based."""
    return _element(rows, keys, value, F.greatest(F.ceil(F.col("__n") * F.lit(q)), F.lit(1)) - 1, name)


def upper_percentile(rows: DataFrame, keys: list[str], value: str, part: int, of: int, name: str) -> DataFrame:
    """v[part * n // of], at most the last."""
    return _element(rows, keys, value, F.least(F.floor(F.col("__n") * part / F.lit(of)), F.col("__n") - 1), name)


def floor_percentile(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """v[min(n - 1, int(q n))]"""
    return _element(rows, keys, value, F.least(F.floor(F.col("__n") * F.lit(q)), F.col("__n") - 1), name)


def rounded_index_percentile(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """v[round(q (n - 1))], halves to even."""
    return _element(rows, keys, value, F.bround((F.col("__n") - 1) * F.lit(q), 0).cast("bigint"), name)


def deciles(rows: DataFrame, by: str, tie: str, *more: str) -> DataFrame:
    """rows with decile 0..9: 0-based position i goes to d where floor(d n / 10) <= i < floor((d + 1) n / 10)."""
    n = rows.count()
    return ranked(rows.select(by, tie, *more), [F.col(by), F.col(tie)]).withColumn("decile", F.floor((F.col("pos") * 10 + 9) / F.lit(max(n, 1))).cast("int"))


def decile_summary(rows: DataFrame, by: str, tie: str, value: str) -> DataFrame:
    """By decile of ``by``: rows, quartiles of ``value`` (upper-element convention), share of rows with value > 0."""
    own = deciles(rows, by, tie, value)
    own = ranked_within(own.select("decile", value), ["decile"], [F.col(value)], "i", "n")
    at = lambda k, name: F.max(F.when(F.col("i") == F.least(F.floor(F.col("n") * k / 4), F.col("n") - 1), F.col(value))).alias(name)
    return own.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), at(1, "q1"), at(2, "median"), at(3, "q3"), (F.count_if(F.col(value) > 0) * 100.0 / F.count(F.lit(1))).alias("prevalence"))


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks with ties averaged, by the counts of distinct values: rank = values below + (own count + 1) / 2."""
    sizes = rows.groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    sizes = ranked(sizes, [F.col(value)], "__p")
    below = running_sum(sizes, "__p", "__c", "__below")
    return rows.join(below.select(F.col(value).alias("__k"), (F.col("__below") + (F.col("__c") + 1) / 2.0).alias(name)), F.col(value).eqNullSafe(F.col("__k"))).drop("__k")


def running_sum(rows: DataFrame, pos: str, value: str, name: str, block: int = 100_000) -> DataFrame:
    """Exclusive prefix sums along 0-based positions in two levels: inside blocks of positions, then over the blocks' totals."""
    own = rows.withColumn("__b", F.floor(F.col(pos) / F.lit(block)))
    inner = Window.partitionBy("__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("__b").agg(F.sum(value).alias("__t"))
    starts = totals.select("__b", F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    return own.withColumn("__w", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(starts, "__b").withColumn(name, F.col("__s") + F.col("__w")).drop("__b", "__w", "__s")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and rho; 0 for fewer than three rows or no variance."""
    own = average_ranks(average_ranks(rows.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "__rx"), y, "__ry")
    r = F.try_divide(F.covar_pop("__rx", "__ry"), F.stddev_pop("__rx") * F.stddev_pop("__ry"))
    return own.agg(F.count(F.lit(1)).alias("n"), r.alias("r")).select("n", F.when((F.col("n") < 3) | F.col("r").isNull() | F.isnan("r"), F.lit(0.0)).otherwise(F.col("r")).alias("rho"))


def bucketed(value: Column, bounds: list[float], labels: list[str]) -> Column:
    """Half-open buckets [bounds[i], bounds[i + 1]), the last one open; null below the first bound."""
    return reduce(lambda acc, x: acc.when(value >= x[0], x[1]), reversed(list(zip(bounds, labels, strict=True))), F)


#: Bounds of pull-count buckets and of age bands in days.
PULL_BOUNDS = [0, 1_000, 100_000, 1_000_000, 10_000_000, 100_000_000, 1_000_000_000]
PULL_LABELS = ["<1k", "1k-100k", "100k-1M", "1M-10M", "10M-100M", "100M-1B", ">=1B"]
AGE_BOUNDS = [0, 90, 180, 365, 730, 1460]
AGE_LABELS = ["0-90", "90-180", "180-365", "365-730", "730-1460", "1460+"]


def bucket_table(rows: DataFrame, value: str, bounds: list[float], labels: list[str]) -> DataFrame:
    """bucket, rows, sum and its share in percent; rows without a number are left out."""
    own = rows.where(F.col(value).isNotNull()).groupBy(bucketed(F.col(value), bounds, labels).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return own.withColumn("pct", F.coalesce(F.try_divide(F.col("total") * 100.0, F.sum("total").over(Window.partitionBy())), F.lit(0.0)))  # one row a bucket


def ecdf(rows: DataFrame, value: str, tie: str) -> DataFrame:
    """value and y = i / n over the sorted rows."""
    n = rows.count()
    return ranked(rows.select(value, tie), [F.col(value), F.col(tie)]).select(value, tie, ((F.col("pos") + 1) / F.lit(float(max(n, 1)))).alias("y"))


def log_density(rows: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Counts in cells of log10(x) and log10(y), rows with both over 0."""
    cell = lambda c: F.floor(F.log10(F.col(c).cast("double")) * bins).cast("bigint")
    return rows.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(cell(x).alias("bx"), cell(y).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The 95 % interval of a share."""
    p, m = hits / n, n.cast("double")
    mid, half, base = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)), 1 + z * z / m
    return (mid - half) / base, (mid + half) / base


def systematic(rows: DataFrame, order: list[Column], stride: int) -> DataFrame:
    """Every stride-th row of the order, from the first."""
    return ranked(rows, order).where(F.col("pos") % stride == 0)
