"""One frame for a whole corpus, and checks of reported values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import rounded_index_percentile, upper_percentile


def is_ok(status: Column) -> Column:
    return status.startswith("ok") | status.startswith("nonzero-ok")


def corpus_summary(targets: DataFrame, invocations: DataFrame, merged: DataFrame) -> DataFrame:
    """(section, key, value): merged findings by severity, category and scanner, packages by how many scanners agree (four
    or more are one), runs, ok runs, mean seconds, peak memory and raw findings by scanner, and counts of targets.

    Each section is an aggregate of its own table; the rows that come out are few, whatever goes in.
    """
    row = lambda section, key, value: [F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value")]
    n = F.count(F.lit(1))
    by = lambda df, section, key: df.groupBy(key.alias("k")).agg(n.alias("n")).select(*row(section, F.col("k"), F.col("n")))
    pkg = merged.where("category = 'pkg-vuln'")
    parts = [by(merged, "severity", F.col("severity")), by(merged, "category", F.col("category")), by(merged.select(F.explode("found_by").alias("s")), "scanner", F.col("s")), by(pkg, "agreement", F.least("n_scanners", F.lit(4)))]
    runs = invocations.groupBy("scanner").agg(n.alias("runs"), F.count_if(is_ok(F.col("status"))).alias("ok"), F.round(F.avg("wall_seconds"), 1).alias("avg_seconds"), F.round(F.max("peak_mem_mb"), 1).alias("peak_mem_mb"))
    parts += [runs.select(*row(c, F.col("scanner"), F.col(c))) for c in ("runs", "ok", "avg_seconds", "peak_mem_mb")]
    total = targets.agg(n.alias("targets"), F.count_if(F.coalesce("skipped_reason", F.lit("")) == "").alias("scanned"), F.count_if(F.coalesce("ip", F.lit("")) != "").alias("with_ip"))
    parts += [total.select(*row("targets", F.lit(c), F.col(c))) for c in ("targets", "scanned", "with_ip")]
    parts.append(merged.agg(n.alias("n")).select(*row("targets", F.lit("merged"), F.col("n"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def throughput(targets: DataFrame, invocations: DataFrame) -> DataFrame:
    """One row: span in seconds, targets a minute and an hour, mean and median (upper element) seconds a target, the sum of
    scanner seconds and what share of the span they are. Times are epoch seconds; a target that ends before it starts has no duration."""
    own = targets.withColumn("seconds", F.when(F.col("finished_at") >= F.col("started_at"), F.col("finished_at") - F.col("started_at")))
    span = F.greatest((F.max("finished_at") - F.min("started_at")).cast("double"), F.lit(1e-9))
    a = own.agg(span.alias("span"), F.count_if(F.coalesce("skipped_reason", F.lit("")) == "").alias("scanned"), F.round(F.avg("seconds"), 1).alias("avg_seconds"))
    middle = upper_percentile(own, [], "seconds", 1, 2, "m").first()  # a row, and another below
    cpu = F.lit(float(invocations.agg(F.coalesce(F.sum("wall_seconds"), F.lit(0.0)).alias("cpu")).first()["cpu"]))
    return a.select(
        F.round("span", 1).alias("span"), F.round(F.col("scanned") / F.col("span") * 60, 3).alias("per_minute"), F.round(F.col("scanned") / F.col("span") * 3600, 1).alias("per_hour"), F.coalesce("avg_seconds", F.lit(0.0)).alias("avg_seconds"),
        F.lit(float(middle["m"]) if middle else 0.0).alias("median_seconds"), F.round(cpu, 1).alias("cpu_seconds"), F.round(cpu / F.col("span"), 2).alias("parallelism"),
    )


def distinct_cves(merged: DataFrame) -> DataFrame:
    """One row: how many identifiers all merged findings name, whatever their case."""
    return merged.select(F.explode("cves").alias("c")).agg(F.count_distinct(F.upper("c")).alias("cves"))


def by_target(merged: DataFrame, severities: tuple[str, ...]) -> DataFrame:
    """Merged findings of each target: all, and by severity."""
    return merged.groupBy("target_name").agg(F.count(F.lit(1)).alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in severities))


def scanner_table(invocations: DataFrame, merged: DataFrame) -> DataFrame:
    """A row for each scanner: runs by outcome, seconds, memory, merged and exclusive findings, and whether it is the only one of some category."""
    own = merged.select(F.explode("found_by").alias("scanner"), "n_scanners", "severity", "category")
    found = own.groupBy("scanner").agg(F.count(F.lit(1)).alias("merged"), F.count_if((F.col("n_scanners") == 1) & ~F.col("severity").isin("info", "unknown")).alias("exclusive_meaningful"), F.count_if(F.col("n_scanners") == 1).alias("exclusive"))
    alone = own.groupBy("category").agg(F.min("scanner").alias("scanner"), F.max("scanner").alias("last")).where("scanner = last").select("scanner").distinct().withColumn("sole", F.lit(True))
    s = F.col("status")
    runs = invocations.groupBy("scanner").agg(F.count(F.lit(1)).alias("runs"), F.count_if(is_ok(s)).alias("ok"), F.count_if(s.startswith("error")).alias("errors"), F.count_if(s.startswith("timeout")).alias("timeouts"), F.count_if(s.startswith("skip")).alias("skips"), F.max("peak_mem_mb").alias("peak_mem_mb"))
    p95 = rounded_index_percentile(invocations, ["scanner"], "wall_seconds", 0.95, "p95")
    out = runs.join(p95, "scanner", "left").join(found, "scanner", "left").join(alone, "scanner", "left")
    return out.fillna(0, ["merged", "exclusive", "exclusive_meaningful"]).withColumn("sole", F.coalesce("sole", F.lit(False)))


def plain_value(text: Column) -> Column:
    """A printed value without grouping, percent signs and braces, blanks folded, a leading plus dropped."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(text, r"\{,\}|\\textbf\{|\\texttt\{|\\%|[,%{}]", ""), r"\s+", " ")), r"^\++", "")


def verified(expected: DataFrame, recomputed: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """name, status of every expected value (name, value, tol, known) against what was recomputed (name, value).

    PASS if the plain values are equal; DRIFT if both are numbers within the check's own tolerance (or the default), relative
    to the expected one; KNOWN where a mismatch is expected; SKIP where nothing was recomputed; else FAIL.
    """
    rows = expected.join(recomputed.select("name", F.col("value").alias("got"), F.lit(True).alias("there")), "name", "left")
    want, got = plain_value(F.col("value")), plain_value(F.col("got"))
    a, b, tol = want.try_cast("double"), got.try_cast("double"), F.coalesce("tol", F.lit(tolerance))
    near = (tol > 0) & F.when(a == 0, b == 0).otherwise(F.abs(b - a) <= tol * F.abs(a))
    status = F.when(F.col("there").isNull(), "SKIP").when(want == got, "PASS").when(F.coalesce(near, F.lit(False)), "DRIFT").when(F.coalesce("known", F.lit(False)), "KNOWN").otherwise("FAIL")
    return rows.select("name", status.alias("status"))


def severity_maps(findings: DataFrame, severities: tuple[str, ...]) -> DataFrame:
    """image, doc: a JSON object by scanner, in order, of counts by severity."""
    own = findings.groupBy("image", "scanner").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in severities))
    pairs = F.array_sort(F.collect_list(F.struct("scanner", F.struct(*severities).alias("counts"))))  # an image's few scanners
    return own.groupBy("image").agg(F.to_json(F.map_from_entries(pairs)).alias("doc"))


def shares_by(images: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """By a property of images: shares of those with a secret, and with a high or critical finding."""
    own = findings.groupBy("image").agg(F.count_if(F.col("category") == "secret").alias("secrets"), F.count_if(F.col("severity").isin("high", "critical")).alias("severe"))
    rows = images.join(own, "image", "left")
    share = lambda c: F.round(F.count_if(F.col(c) > 0) * 100.0 / F.count(F.lit(1)), 6)
    return rows.groupBy(key).agg(share("secrets").alias("secret_pct"), share("severe").alias("severe_pct"))


def first_seen(findings: DataFrame, images: DataFrame) -> DataFrame:
    """By identifier: severity and package of its first finding, and how many distinct digests it is in."""
    rows = findings.join(images, "image").groupBy("id", "digest").agg(F.min(F.struct("seq", "severity", "package")).alias("x"))
    return rows.groupBy("id").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("digests")).select("id", "x.severity", "x.package", "digests")


def language_families(findings: DataFrame) -> DataFrame:
    """High and critical package findings of three language families."""
    eco = F.lower("ecosystem")
    family = F.when(eco.isin("go-module", "go", "golang"), "go").when(eco == "npm", "npm").when(eco.isin("pypi", "python"), "py")
    return findings.where("category = 'pkg-vuln' AND severity IN ('high', 'critical')").select(family.alias("family")).where("family IS NOT NULL").groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def progress(rows: DataFrame, done: Column, at: str) -> DataFrame:
    """One row: total, built, share in percent, how many an hour over the times seen, and the hours that the rest will take."""
    own = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("built"), ((F.max(at) - F.min(at)) / 3600).alias("hours"))
    pace = F.try_divide(F.col("built").cast("double"), F.col("hours"))
    return own.select("total", "built", F.coalesce(F.try_divide(F.col("built") * 100.0, F.col("total")), F.lit(0.0)).alias("pct"), pace.alias("per_hour"), F.try_divide(F.col("total") - F.col("built"), pace).alias("hours_left"))
