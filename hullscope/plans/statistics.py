"""Queries on distributions: percentile conventions, deciles, rank correlation, buckets, bands, densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import age_days, is_official
from ..operators import stats
from ..operators.checkpoint import kept
from ..sources.readers import table
from . import views
from .registry import query

r6 = lambda c: F.round(c, 6).alias(c)
POS = "(SELECT status, pull, row_number() OVER (PARTITION BY status ORDER BY pull) - 1 AS i, count(*) OVER (PARTITION BY status) AS n FROM {images})"


def images(s, d):
    return views.images(s, d)


query("percentile_linear", "SELECT status, round(quantile_cont(pull, 0.25), 6) AS p25, round(quantile_cont(pull, 0.5), 6) AS p50, round(quantile_cont(pull, 0.9), 6) AS p90, round(quantile_cont(pull, 0.99), 6) AS p99 FROM {images} GROUP BY status")(
    lambda s, d: stats.linear_percentiles(images(s, d), ["status"], "pull", {f"p{round(q * 100)}": q for q in (0.25, 0.5, 0.9, 0.99)}).select("status", *(F.round(f"p{x}", 6).alias(f"p{x}") for x in (25, 50, 90, 99)))
)
query("percentile_nearest_rank", f"SELECT status, max(CASE WHEN i + 1 = greatest(CAST(ceil(n * 0.5E0) AS BIGINT), 1) THEN pull END) AS p50, max(CASE WHEN i + 1 = greatest(CAST(ceil(n * 0.99E0) AS BIGINT), 1) THEN pull END) AS p99 FROM {POS} GROUP BY status")(
    lambda s, d: stats.nearest_rank_percentile(images(s, d), ["status"], "pull", 0.5, "p50").join(stats.nearest_rank_percentile(images(s, d), ["status"], "pull", 0.99, "p99"), "status")
)
query("percentile_upper_element", f"SELECT status, max(CASE WHEN i = least(n // 4, n - 1) THEN pull END) AS q1, max(CASE WHEN i = least(n // 2, n - 1) THEN pull END) AS q2, max(CASE WHEN i = least(9 * n // 10, n - 1) THEN pull END) AS p90 FROM {POS} GROUP BY status")(
    lambda s, d: stats.upper_percentile(images(s, d), ["status"], "pull", 1, 4, "q1").join(stats.upper_percentile(images(s, d), ["status"], "pull", 1, 2, "q2"), "status").join(stats.upper_percentile(images(s, d), ["status"], "pull", 9, 10, "p90"), "status")
)
query("percentile_floor_index", f"SELECT status, max(CASE WHEN i = least(CAST(floor(n * 0.9E0) AS BIGINT), n - 1) THEN pull END) AS p90 FROM {POS} GROUP BY status")(lambda s, d: stats.floor_percentile(images(s, d), ["status"], "pull", 0.9, "p90"))
query("percentile_rounded_index", f"SELECT status, max(CASE WHEN i = CAST(round_even((n - 1) * 0.5E0, 0) AS BIGINT) THEN pull END) AS p50, max(CASE WHEN i = CAST(round_even((n - 1) * 0.95E0, 0) AS BIGINT) THEN pull END) AS p95 FROM {POS} GROUP BY status")(
    lambda s, d: stats.rounded_index_percentile(images(s, d), ["status"], "pull", 0.5, "p50").join(stats.rounded_index_percentile(images(s, d), ["status"], "pull", 0.95, "p95"), "status")
)
query("median_true", "SELECT status, round(median(pull), 6) AS median FROM {images} GROUP BY status")(lambda s, d: stats.true_medians(images(s, d), ["status"], "pull", "median").withColumn("median", F.round("median", 6)))
query(
    "exposure_deciles",
    """WITH x AS (SELECT exposure, image, CAST((10 * (row_number() OVER (ORDER BY exposure, image) - 1) + 9) // count(*) OVER () AS INTEGER) AS decile, downstream FROM {images}),
 y AS (SELECT decile, downstream, row_number() OVER (PARTITION BY decile ORDER BY downstream) - 1 AS i, count(*) OVER (PARTITION BY decile) AS n FROM x)
 SELECT decile, count(*) AS n, max(CASE WHEN i = least(n // 4, n - 1) THEN downstream END) AS q1, max(CASE WHEN i = least(n // 2, n - 1) THEN downstream END) AS median, max(CASE WHEN i = least(3 * n // 4, n - 1) THEN downstream END) AS q3, round(count(*) FILTER (downstream > 0) * 100.0E0 / count(*), 6) AS prevalence FROM y GROUP BY decile""",
)(lambda s, d: stats.decile_summary(images(s, d), "exposure", "image", "downstream").withColumn("prevalence", F.round("prevalence", 6)))
query(
    "spearman_exposure",
    """WITH r AS (SELECT rank() OVER (ORDER BY pull) + (count(*) OVER (PARTITION BY pull) - 1) / 2.0E0 AS rx, rank() OVER (ORDER BY dependency_weight) + (count(*) OVER (PARTITION BY dependency_weight) - 1) / 2.0E0 AS ry FROM {images})
 SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""",
)(lambda s, d: stats.spearman(images(s, d), "pull", "dependency_weight").withColumn("rho", F.round("rho", 6)))
query("pearson_exposure", "SELECT round(corr(pull, downstream), 6) AS r FROM {images}")(lambda s, d: images(s, d).agg(F.round(F.corr("pull", "downstream"), 6).alias("r")))
BUCKET = "CASE " + " ".join(f"WHEN v >= {b} THEN '{n}'" for b, n in reversed(list(zip(stats.PULL_BOUNDS, stats.PULL_LABELS, strict=True)))) + " END"
query("pull_buckets", f"SELECT {BUCKET} AS bucket, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, round(sum(v) * 100.0E0 / sum(sum(v)) OVER (), 6) AS pct FROM (SELECT pull * (1 + image % 3000) AS v FROM {{images}}) GROUP BY 1")(
    lambda s, d: stats.bucket_table(images(s, d).withColumn("v", F.col("pull") * (1 + F.col("image") % 3000)), "v", stats.PULL_BOUNDS, stats.PULL_LABELS).withColumn("pct", F.round("pct", 6))
)
BAND = "CASE " + " ".join(f"WHEN age >= {b} THEN '{n}'" for b, n in reversed(list(zip(stats.AGE_BOUNDS, stats.AGE_LABELS, strict=True)))) + " END"
AS_OF = "2002-01-01"
query("age_bands", f"SELECT {BAND} AS band, count(*) AS n, round(quantile_cont(pull, 0.5), 6) AS median, round(avg(pull), 4) AS mean, round(quantile_cont(pull, 0.9), 6) AS p90 FROM (SELECT pull, date_diff('day', updated, TIMESTAMP '{AS_OF}') AS age FROM {{images}}) GROUP BY 1")(
    lambda s, d: images(s, d).withColumn("age", age_days(F.col("updated").cast("timestamp"), F.lit(AS_OF).cast("timestamp"))).groupBy(stats.bucketed(F.col("age"), stats.AGE_BOUNDS, stats.AGE_LABELS).alias("band"))
    .agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("pull", 0.5), 6).alias("median"), F.round(F.avg("pull"), 4).alias("mean"), F.round(F.percentile("pull", 0.9), 6).alias("p90"))
)
query("age_years", f"SELECT CAST(floor(date_diff('day', updated, TIMESTAMP '{AS_OF}') / 365) AS INTEGER) AS years, count(*) AS n, round(quantile_cont(pull, 0.5), 6) AS median, round(quantile_cont(pull, 0.75), 6) AS p75 FROM {{images}} GROUP BY 1 HAVING count(*) >= 30")(
    lambda s, d: images(s, d).groupBy(F.greatest(F.lit(0), F.floor(F.datediff(F.lit(AS_OF).cast("date"), F.col("updated").cast("date")) / 365)).cast("int").alias("years")).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("pull", 0.5), 6).alias("median"), F.round(F.percentile("pull", 0.75), 6).alias("p75")).where("n >= 30")
)
query("official_against_community", "SELECT lower(trim(ns)) IN ('', 'library') AS official, count(*) AS n, round(quantile_cont(pull, 0.5), 6) AS median, round(avg(pull), 4) AS mean, round(quantile_cont(pull, 0.9), 6) AS p90, round(count(*) FILTER (dependency_weight > 25) * 100.0E0 / count(*), 6) AS heavy_pct FROM {images} GROUP BY 1")(
    lambda s, d: images(s, d).groupBy(is_official(F.col("ns")).alias("official")).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("pull", 0.5), 6).alias("median"), F.round(F.avg("pull"), 4).alias("mean"), F.round(F.percentile("pull", 0.9), 6).alias("p90"), F.round(F.count_if(F.col("dependency_weight") > 25) * 100.0 / F.count(F.lit(1)), 6).alias("heavy_pct"))
)
query("young_against_old", f"SELECT round(median(CASE WHEN age < 1500 THEN pull END), 6) AS young, round(median(CASE WHEN age >= 1500 THEN pull END), 6) AS old, round(count(age) * 100.0E0 / count(*), 6) AS coverage FROM (SELECT pull, date_diff('day', updated, TIMESTAMP '{AS_OF}') AS age FROM {{images}})")(
    lambda s, d: images(s, d).withColumn("age", F.datediff(F.lit(AS_OF).cast("date"), F.col("updated").cast("date"))).agg(F.round(F.percentile(F.when(F.col("age") < 1500, F.col("pull")), 0.5), 6).alias("young"), F.round(F.percentile(F.when(F.col("age") >= 1500, F.col("pull")), 0.5), 6).alias("old"), F.round(F.count("age") * 100.0 / F.count(F.lit(1)), 6).alias("coverage"))
)
query("crawl_totals", "SELECT count(*) AS n, CAST(sum(pull) AS BIGINT) AS pulls, count(*) FILTER (digest <> '') AS with_digest, round(count(*) FILTER (digest <> '') * 100.0E0 / count(*), 6) AS coverage FROM {images}")(
    lambda s, d: images(s, d).agg(F.count(F.lit(1)).alias("n"), F.sum("pull").alias("pulls"), F.count_if(F.col("digest") != "").alias("with_digest"), F.round(F.count_if(F.col("digest") != "") * 100.0 / F.count(F.lit(1)), 6).alias("coverage"))
)
query("pull_thresholds", "SELECT t AS threshold, count(*) AS n FROM {images}, (VALUES (10000), (100000), (400000)) v(t) WHERE pull >= t GROUP BY t")(
    lambda s, d: images(s, d).select(F.explode(F.filter(F.array(*map(F.lit, (10000, 100000, 400000))), lambda t: F.col("pull") >= t)).alias("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))
)
query("ecdf_pull", "SELECT image, pull, round(row_number() OVER (ORDER BY pull, image) / CAST(count(*) OVER () AS DOUBLE), 6) AS y FROM {images}")(lambda s, d: stats.ecdf(images(s, d), "pull", "image").withColumn("y", F.round("y", 6)))
query("log_density", "SELECT CAST(floor(log10(pull) * 4) AS BIGINT) AS bx, CAST(floor(log10(downstream) * 4) AS BIGINT) AS \"by\", count(*) AS n FROM {images} WHERE pull > 0 AND downstream > 0 GROUP BY 1, 2")(lambda s, d: stats.log_density(images(s, d), "pull", "downstream", 4))


def _wilson(s, d):
    rows = images(s, d).groupBy("status").agg(F.count_if(F.col("digest") == "").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("status", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


Z = "1.959963984540054E0"
_MID, _HALF, _BASE = f"(p + {Z} * {Z} / (2 * n))", f"({Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n)))", f"(1 + {Z} * {Z} / n)"
query("wilson_interval", f"SELECT status, k, CAST(n AS BIGINT) AS n, round(({_MID} - {_HALF}) / {_BASE}, 6) AS low, round(({_MID} + {_HALF}) / {_BASE}, 6) AS high FROM (SELECT status, count(*) FILTER (digest = '') AS k, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (digest = '') / CAST(count(*) AS DOUBLE) AS p FROM {{images}} GROUP BY status)")(_wilson)
query("systematic_sample", "SELECT image, pull FROM (SELECT image, pull, row_number() OVER (ORDER BY pull DESC, image) - 1 AS i FROM {images}) WHERE i % 100 = 0")(lambda s, d: stats.systematic(images(s, d).select("image", "pull"), [F.col("pull").desc(), F.col("image")], 100).select("image", "pull"))
query("above_median_share", f"SELECT status, round(count(*) FILTER (pull > m) * 100.0E0 / count(*), 6) AS pct FROM (SELECT status, pull, max(CASE WHEN i = n // 2 THEN pull END) OVER (PARTITION BY status) AS m FROM {POS}) GROUP BY status")(
    lambda s, d: images(s, d).join(stats.checked(kept(stats.upper_percentile(images(s, d), ["status"], "pull", 1, 2, "m"))), "status").groupBy("status").agg(F.round(F.count_if(F.col("pull") > F.col("m")) * 100.0 / F.count(F.lit(1)), 6).alias("pct"))
)
query("volume_spread", "SELECT round(max(n) / CAST(min(n) AS DOUBLE), 6) AS spread FROM (SELECT count(*) AS n FROM {findings} GROUP BY scanner)")(lambda s, d: views.findings(s, d).groupBy("scanner").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.max("n") / F.min("n"), 6).alias("spread")))
query("running_marginal_share", "SELECT scanner, n, round(CAST(sum(n) OVER (ORDER BY n DESC, scanner) AS DOUBLE) / sum(n) OVER (), 6) AS share FROM (SELECT scanner, count(*) AS n FROM {findings} GROUP BY scanner)")(
    lambda s, d: stats.running_sum(stats.ranked(views.findings(s, d).groupBy("scanner").agg(F.count(F.lit(1)).alias("n")), [F.col("n").desc(), F.col("scanner")]), "pos", "n", "b").select("scanner", "n", F.round((F.col("b") + F.col("n")) / F.lit(views.findings(s, d).count()), 6).alias("share"))
)
query("decile_sizes", "SELECT CAST((10 * (row_number() OVER (ORDER BY pull, image) - 1) + 9) // count(*) OVER () AS INTEGER) AS decile, image FROM {images}")(lambda s, d: stats.deciles(images(s, d), "pull", "image").select("decile", "image"))
query("throughput", "SELECT date_diff('second', min(ts), max(ts)) AS span_s, round(count(*) / (date_diff('second', min(ts), max(ts)) / 60.0E0), 3) AS per_minute, count(*) AS n, round(avg(value), 4) AS avg_value FROM events")(
    lambda s, d: table(s, d, "events").agg(F.round(F.unix_seconds(F.max(F.col("ts").cast("timestamp"))) - F.unix_seconds(F.min(F.col("ts").cast("timestamp"))), 0).cast("bigint").alias("span_s"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"))
    .select("span_s", F.round(F.col("n") / (F.col("span_s") / 60), 3).alias("per_minute"), "n", F.round("avg_value", 4).alias("avg_value"))
)
