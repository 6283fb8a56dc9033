"""Prevalence, per-image and per-package statistics of findings, and the merge of what several scanners report.

A findings table has the columns of ``schemas.FINDING`` (those an operator needs), an ``image`` (the analysis unit) and a
``seq`` (input order): wherever "first" decides, the smallest seq does, with the row's values as the tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import SEVERITIES, known_or_unknown, severity_name, severity_rank
from ..functions.text import cve_year, ecosystem, ecosystem_class, filled, package_name

SCANNERS = ("trivy", "grype", "osv")


def corrected(findings: DataFrame, osv_severities: DataFrame | None = None, exclude: tuple[str, ...] = ("clair",)) -> DataFrame:
    """What the analysis pass changes: excluded scanners go, OSV findings of unknown severity get the cache's, a dockle 'high' is critical."""
    rows = findings.where(~F.col("scanner").isin(*exclude)) if exclude else findings
    severity = F.col("severity")
    if osv_severities is not None:  # one row an id (the last one wins): a plain left join, broadcast by size at run time
        cache = osv_severities.groupBy(F.col("id").alias("__id")).agg(F.max_by("severity", "seq").alias("__severity"))
        rows = rows.join(cache, F.col("id") == F.col("__id"), "left")
        open_ = (F.col("scanner") == "osv") & (F.col("category") == "pkg-vuln") & filled(F.lower(severity), "unknown").isin("unknown", "none", "null")
        severity = F.when(open_, F.coalesce("__severity", severity)).otherwise(severity)
    severity = F.when((F.col("scanner") == "dockle") & (severity == "high"), "critical").otherwise(severity)
    return rows.withColumn("severity", known_or_unknown(severity)).drop("__id", "__severity")


def counts(rows: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def filled_counts(rows: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """A row for each of the given values, 0 where there is none."""
    sums = [F.count(F.when(F.col(key) == v, 1)).alias(v) for v in values]
    return rows.agg(*sums).select(F.inline(F.array(*(F.struct(F.lit(v).alias(key), F.col(v).alias("n")) for v in values))))


def by_scanner_and_severity(rows: DataFrame) -> DataFrame:
    """A column for each severity, zeros filled in."""
    return rows.groupBy("scanner").agg(*(F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES))


def per_image(images: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for every image, zeros kept: counts by category, worst rank, flags."""
    is_ = lambda c: F.col("category") == c
    vuln = is_("pkg-vuln")
    own = findings.groupBy("image").agg(
        F.count(F.when(vuln, 1)).alias("n_vulns"),
        F.count(F.when(is_("sbom-component"), 1)).alias("n_components"),
        F.count(F.when(is_("secret"), 1)).alias("n_secrets"),
        F.count(F.when(is_("image-config"), 1)).alias("n_misconfigs"),
        F.max(F.when(vuln, severity_rank(F.col("severity")))).alias("worst_rank"),
        F.count(F.when(vuln & (F.col("severity") == "critical"), 1)).alias("n_critical"),
        F.count(F.when(vuln & (F.col("severity") == "high"), 1)).alias("n_high"),
        F.bool_or(is_("secret") & F.lower(F.col("title")).contains("private key")).alias("has_private_key"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return images.select("image").distinct().join(own, "image", "left").select(
        "image", *map(zero, ("n_vulns", "n_components", "n_secrets", "n_misconfigs", "n_critical", "n_high")), F.coalesce(severity_name(F.col("worst_rank")), F.lit("none")).alias("worst"), F.coalesce("has_private_key", F.lit(False)).alias("has_private_key")
    )


def prevalence(per: DataFrame) -> DataFrame:
    """Images with at least one ..., with shares in percent."""
    flags = {"vulnerability": F.col("n_vulns") > 0, "critical": F.col("n_critical") > 0, "high": F.col("n_high") > 0, "secret": F.col("n_secrets") > 0, "misconfig": F.col("n_misconfigs") > 0, "private_key": F.col("has_private_key")}
    row = per.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    return row.select("total", F.inline(F.array(*(F.struct(F.lit(k).alias("what"), F.col(k).alias("n")) for k in flags)))).select("what", "n", F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("total")), F.lit(0.0)).alias("pct"))


def images_per_severity(findings: DataFrame) -> DataFrame:
    return findings.where("category = 'pkg-vuln'").groupBy("severity").agg(F.count_distinct("image").alias("images"))


def cves_by_year(findings: DataFrame) -> DataFrame:
    """Distinct identifiers (upper case) by year, those that begin like a CVE."""
    rows = findings.select(F.upper("id").alias("cve"), cve_year(F.col("id")).alias("year")).where("year IS NOT NULL")
    return rows.groupBy("year").agg(F.count_distinct("cve").alias("cves"))


def packages(findings: DataFrame) -> DataFrame:
    """By normalised name: images, findings, distinct CVEs, images with a critical, most frequent ecosystem (least name of equals).

    Each distinct count comes from its own small aggregate by (name, value), so no row is expanded for several of them.
    """
    rows = findings.where("category = 'pkg-vuln'").select("image", "severity", package_name(F.col("package")).alias("name"), ecosystem(F.col("ecosystem")).alias("eco"), F.upper("id").alias("cve"), cve_year(F.col("id")).alias("year")).where("name <> ''")
    eco = rows.groupBy("name", "eco").agg(F.count(F.lit(1)).alias("n")).groupBy("name").agg(F.min_by("eco", F.struct(-F.col("n"), F.col("eco"))).alias("ecosystem"))
    images = rows.groupBy("name", "image").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("severity") == "critical").alias("critical")).groupBy("name").agg(F.count(F.lit(1)).alias("images"), F.sum("n").alias("findings"), F.count_if("critical").alias("critical_images"))
    cves = rows.where("year IS NOT NULL").groupBy("name", "cve").agg(F.lit(1)).groupBy("name").agg(F.count(F.lit(1)).alias("cves"))
    return images.join(cves, "name", "left").join(eco, "name").select("name", "images", "findings", F.coalesce("cves", F.lit(0)).alias("cves"), "critical_images", "ecosystem")


def components(findings: DataFrame) -> DataFrame:
    """SBOM components by ecosystem, raw and in lower case ('unknown' where empty)."""
    eco = filled(F.col("ecosystem"), "unknown")
    return findings.where("category = 'sbom-component'").groupBy(eco.alias("ecosystem"), F.lower(eco).alias("ecosystem_lower")).agg(F.count(F.lit(1)).alias("components"), F.count_distinct("image").alias("images"))


def secrets(findings: DataFrame) -> DataFrame:
    """By detector: title, else id, else '?'."""
    return findings.where("category = 'secret'").groupBy(filled(F.col("title"), filled(F.col("id"), "?")).alias("detector")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image").alias("images"))


def misconfigs(findings: DataFrame) -> DataFrame:
    """Images by check (id, else title, else 'unknown'), each image once."""
    return findings.where("category = 'image-config'").groupBy(filled(F.col("id"), filled(F.col("title"), "unknown")).alias("check")).agg(F.count_distinct("image").alias("images"))


def severe_by_ecosystem(findings: DataFrame) -> DataFrame:
    rows = findings.where("category = 'pkg-vuln' AND severity IN ('high', 'critical')")
    return rows.groupBy(ecosystem_class(F.col("ecosystem")).alias("class"), ecosystem(F.col("ecosystem")).alias("ecosystem")).agg(F.count(F.lit(1)).alias("n"))


def per_cve(findings: DataFrame, images: DataFrame) -> DataFrame:
    """By identifier (its own case) that starts like a CVE: images, exposure, distinct digests (an image's first row of a digest
    counts; a missing digest counts as new), sums, worst severity and the package of its first worst finding."""
    rows = findings.where((F.col("category") == "pkg-vuln") & F.upper("id").startswith("CVE-"))
    worst = rows.groupBy("id").agg(F.max(severity_rank(F.col("severity"))).alias("rank"), F.min_by("package", F.struct(-severity_rank(F.col("severity")), F.col("seq"), F.col("package"))).alias("package"))
    first = F.row_number().over(Window.partitionBy(F.coalesce(F.nullif("digest", F.lit("")), F.concat(F.lit("#"), F.col("image").cast("string")))).orderBy("image")) == 1
    own = images.select("image", "exposure", "dependency_weight", "downstream", first.alias("is_first"))
    pairs = rows.select("id", "image").distinct().join(own, "image")
    sums = pairs.groupBy("id").agg(
        F.count(F.lit(1)).alias("images"), F.sum("exposure").alias("exposure"), F.count_if("is_first").alias("digests"),
        F.coalesce(F.sum(F.when(F.col("is_first"), F.col("dependency_weight"))), F.lit(0)).alias("dependency_weight"), F.coalesce(F.sum(F.when(F.col("is_first"), F.col("downstream"))), F.lit(0)).alias("downstream"),
    )
    return sums.join(worst, "id").select("id", "images", "exposure", "digests", "dependency_weight", "downstream", severity_name(F.col("rank")).alias("worst"), "package")


def top_digests(findings: DataFrame, images: DataFrame, most: int) -> DataFrame:
    """The identifiers with most distinct digests, with a hash of their sorted digests: only the chosen ones' are gathered."""
    pairs = findings.where("startswith(id, 'CVE-')").select("id", "image").distinct().join(images.where("digest <> ''").select("image", "digest"), "image").select("id", "digest").distinct()
    top = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_digests")).orderBy(F.col("n_digests").desc(), "id").limit(most)
    return pairs.join(F.broadcast(top), "id").groupBy("id", "n_digests").agg(F.md5(F.array_join(F.array_sort(F.collect_list("digest")), ",")).alias("digests_md5"))  # most rows


def severe_bins(images: DataFrame, findings: DataFrame) -> DataFrame:
    """Images by their number of critical and high findings, in six bins; an image without any is in '0'."""
    own = findings.where("severity IN ('critical', 'high')").groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    rows = images.select("image").distinct().join(own, "image", "left")
    return counts(rows, F.when(n >= 30, "30+").when(n >= 20, "20-29").when(n >= 10, "10-19").when(n >= 5, "5-9").when(n >= 1, "1-4").otherwise("0").alias("bin"), name="images")


def merge_key() -> list[Column]:
    """Target, category, id else title, package, endpoint else location, in lower case; the version isn't part of it."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return [low(F.col("target_name")).alias("k_target"), F.col("category").alias("k_category"), low(filled(F.col("id"), F.col("title"))).alias("k_id"), low(F.col("package")).alias("k_package"), low(filled(F.col("endpoint"), F.col("location"))).alias("k_place")]


def merged(findings: DataFrame) -> DataFrame:
    """One row a key: worst severity, highest CVSS, sorted unions, first filled-in fields, and who found it.

    The representative (whose id, title, package and so on stay) is the row of highest (severity, cvss), the first of
    equals. Collected sets hold distinct scanners, identifiers and references of one finding only.
    """
    rank = severity_rank(F.col("severity"))
    best = F.struct(-rank, -F.coalesce("cvss", F.lit(0.0)), F.col("seq"))
    chosen = ("target_name", "category", "id", "title", "package", "version", "location")
    first = lambda c: F.min_by(F.nullif(c, F.lit("")), F.when(F.coalesce(c, F.lit("")) != "", F.col("seq"))).alias(c)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>"))))))
    rows = findings.groupBy(*merge_key()).agg(
        F.min_by(F.struct(*chosen), best).alias("__best"),
        severity_name(F.max(rank)).alias("severity"), F.max("cvss").alias("cvss"), F.array_distinct(F.transform(union("cves"), F.upper)).alias("cves"), union("references").alias("references"),
        first("target_ip"), first("endpoint"), first("fixed_version"), F.array_sort(F.collect_set("scanner")).alias("found_by"), F.count(F.lit(1)).alias("n_raw"),
    )
    rows = rows.select(*(F.col(f"__best.{c}").alias(c) for c in chosen), *(c for c in rows.columns if c != "__best" and not c.startswith("k_")))
    return rows.withColumn("cves", F.array_sort("cves")).withColumn("n_scanners", F.size("found_by"))


def agreement_histogram(rows: DataFrame, cap: int = 4) -> DataFrame:
    """Merged findings by how many scanners found them, capped."""
    return rows.groupBy(F.least(F.col("n_scanners"), F.lit(cap)).alias("scanners")).agg(F.count(F.lit(1)).alias("n"))


def jaccard(rows: DataFrame) -> DataFrame:
    """Intersection over union of the sets of merged findings of each two scanners. Pairs come from each finding's own
    few scanners, so the rows made are bounded by scanners squared for a finding, never by pairs of findings."""
    pairs = rows.select(F.explode("found_by").alias("a"), "found_by").select("a", F.explode("found_by").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    size = pairs.where("a = b").select(F.col("a").alias("s"), F.col("n_both").alias("n"))
    left, right = size.toDF("a", "na"), size.toDF("b", "nb")
    return pairs.where("a < b").join(left, "a").join(right, "b").select("a", "b", "n_both", (F.col("n_both") / (F.col("na") + F.col("nb") - F.col("n_both"))).alias("jaccard"))


def exclusive(rows: DataFrame) -> DataFrame:
    """By scanner: merged findings, those nobody else has, and those of them that mean something (not info or unknown)."""
    own = rows.select(F.explode("found_by").alias("scanner"), "n_scanners", "severity")
    return own.groupBy("scanner").agg(F.count(F.lit(1)).alias("merged"), F.count_if(F.col("n_scanners") == 1).alias("exclusive"), F.count_if((F.col("n_scanners") == 1) & ~F.col("severity").isin("info", "unknown")).alias("exclusive_meaningful"))


def severity_by_category(rows: DataFrame) -> DataFrame:
    """With totals (null key) by grouping sets."""
    return rows.rollup("category", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def invocation_table(invocations: DataFrame) -> DataFrame:
    """By scanner: runs, ok, errors, timeouts, skips, mean, median and 95th percentile (rounded index) of seconds, peak memory."""
    ok = F.col("status").startswith("ok") | F.col("status").startswith("nonzero-ok")
    from .stats import rounded_index_percentile

    base = invocations.groupBy("scanner").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("ok"), F.count_if(F.col("status").startswith("error")).alias("errors"), F.count_if(F.col("status").startswith("timeout")).alias("timeouts"),
        F.count_if(F.col("status").startswith("skip")).alias("skips"), F.avg("wall_seconds").alias("avg_seconds"), F.max("peak_mem_mb").alias("peak_mem_mb"),
    )
    for q in (0.5, 0.95):
        base = base.join(rounded_index_percentile(invocations, ["scanner"], "wall_seconds", q, f"p{round(q * 100)}"), "scanner", "left")
    return base
