"""Queries on findings: severity, prevalence, packages, agreement of scanners, merged findings."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from ..functions import severity
from ..operators import agreement, findings as ops, search
from ..operators.snapshots import fresh
from ..sources.readers import table
from . import views
from .registry import query

RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
NAME = "CASE {r} WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' WHEN 1 THEN 'info' WHEN 0 THEN 'unknown' END"
PKG = "lower(list_extract(string_split(split_part(package, '@', 1), '/'), -1))"
ECO = "split_part(split_part(lower(trim(ecosystem)), ':', 1), '/', 1)"
CLASS = f"CASE WHEN {ECO} IN ('deb', 'apk') THEN 'os' WHEN {ECO} IN ('npm', 'go-module', 'pypi') THEN 'lang' ELSE 'other' END"
GROUPS = f"""(SELECT image, id AS cve, package, bit_or(CASE scanner WHEN 'trivy' THEN 1 WHEN 'grype' THEN 2 ELSE 4 END) AS mask, max({RANK}) AS rank,
 max(CASE WHEN scanner = 'trivy' THEN {RANK} END) AS rank_trivy, max(CASE WHEN scanner = 'grype' THEN {RANK} END) AS rank_grype, max(CASE WHEN scanner = 'osv' THEN {RANK} END) AS rank_osv, arg_min(ecosystem, (seq, ecosystem)) AS ecosystem
 FROM {{findings}} WHERE category = 'pkg-vuln' GROUP BY image, id, package)"""
PER_IMAGE = f"""(SELECT i.image, coalesce(n_vulns, 0) AS n_vulns, coalesce(n_components, 0) AS n_components, coalesce(n_secrets, 0) AS n_secrets, coalesce(n_misconfigs, 0) AS n_misconfigs, coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high,
 coalesce({NAME.format(r="worst")}, 'none') AS worst, coalesce(pk, false) AS has_private_key FROM {{images}} i LEFT JOIN
 (SELECT image, count(*) FILTER (category = 'pkg-vuln') AS n_vulns, count(*) FILTER (category = 'sbom-component') AS n_components, count(*) FILTER (category = 'secret') AS n_secrets, count(*) FILTER (category = 'image-config') AS n_misconfigs,
  count(*) FILTER (category = 'pkg-vuln' AND severity = 'critical') AS n_critical, count(*) FILTER (category = 'pkg-vuln' AND severity = 'high') AS n_high, max({RANK}) FILTER (category = 'pkg-vuln') AS worst, bool_or(category = 'secret' AND title = 'private key') AS pk
  FROM {{findings}} GROUP BY image) f ON i.image = f.image)"""


def per_image(spark, sf_dir):
    return ops.per_image(views.images(spark, sf_dir), views.findings(spark, sf_dir))


def groups(spark, sf_dir):
    """Co-detection groups, which a dozen queries read: built once for a state of the tables that they come from."""
    return fresh(spark, "codetection", [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part")], lambda: agreement.groups(views.findings(spark, sf_dir)), (agreement, severity, views))


query("findings_by_severity", "SELECT severity, count(*) AS n FROM {findings} GROUP BY severity")(lambda s, d: ops.counts(views.findings(s, d), "severity"))
query("findings_by_scanner_severity", "SELECT scanner, " + ", ".join(f"count(*) FILTER (severity = '{x}') AS {x}" for x in ops.SEVERITIES) + " FROM {findings} GROUP BY scanner")(lambda s, d: ops.by_scanner_and_severity(views.findings(s, d)))
query("corpus_units", "SELECT count(*) AS n_rows, count(*) FILTER (digest = '') AS missing_digests, count(DISTINCT nullif(digest, '')) + count(*) FILTER (digest = '') AS distinct_digests FROM {images}")(
    lambda s, d: views.images(s, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("digest") == "").alias("missing_digests"), (F.count_distinct(F.nullif("digest", F.lit(""))) + F.count_if(F.col("digest") == "")).alias("distinct_digests"))
)
query("per_image_counts", f"SELECT * FROM {PER_IMAGE}")(per_image)
query("worst_severity_histogram", f"SELECT worst, count(*) AS n FROM {PER_IMAGE} GROUP BY worst")(lambda s, d: ops.counts(per_image(s, d), "worst"))
_WHAT = {"vulnerability": "n_vulns > 0", "critical": "n_critical > 0", "high": "n_high > 0", "secret": "n_secrets > 0", "misconfig": "n_misconfigs > 0", "private_key": "has_private_key"}
query("prevalence", " UNION ALL ".join(f"SELECT '{k}' AS what, count(*) FILTER ({c}) AS n, round(count(*) FILTER ({c}) * 100.0E0 / count(*), 6) AS pct FROM {PER_IMAGE}" for k, c in _WHAT.items()))(lambda s, d: ops.prevalence(per_image(s, d)).withColumn("pct", F.round("pct", 6)))
query("images_per_severity", "SELECT severity, count(DISTINCT image) AS images FROM {findings} WHERE category = 'pkg-vuln' GROUP BY severity")(lambda s, d: ops.images_per_severity(views.findings(s, d)))
query("cves_by_year", "SELECT CAST(regexp_extract(id, '^CVE-(\\d{4})-\\d+', 1) AS INTEGER) AS year, count(DISTINCT upper(id)) AS cves FROM {findings} WHERE id LIKE 'CVE-%' GROUP BY 1")(lambda s, d: ops.cves_by_year(views.findings(s, d)))
query(
    "package_statistics",
    f"""WITH r AS (SELECT image, severity, {PKG} AS name, {ECO} AS eco, CASE WHEN id LIKE 'CVE-%' THEN upper(id) END AS cve FROM {{findings}} WHERE category = 'pkg-vuln'),
 e AS (SELECT name, eco, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, eco) AS k FROM r GROUP BY name, eco)
 SELECT r.name, count(DISTINCT image) AS images, count(*) AS findings, count(DISTINCT cve) AS cves, count(DISTINCT CASE WHEN severity = 'critical' THEN image END) AS critical_images, any_value(e.eco) AS ecosystem FROM r JOIN e ON r.name = e.name AND k = 1 GROUP BY r.name""",
)(lambda s, d: ops.packages(views.findings(s, d)))
query("sbom_components", "SELECT CASE WHEN ecosystem = '' THEN 'unknown' ELSE ecosystem END AS ecosystem, lower(CASE WHEN ecosystem = '' THEN 'unknown' ELSE ecosystem END) AS ecosystem_lower, count(*) AS components, count(DISTINCT image) AS images FROM {findings} WHERE category = 'sbom-component' GROUP BY 1, 2")(lambda s, d: ops.components(views.findings(s, d)))
query("secrets_by_detector", "SELECT title AS detector, count(*) AS n, count(DISTINCT image) AS images FROM {findings} WHERE category = 'secret' GROUP BY 1")(lambda s, d: ops.secrets(views.findings(s, d)))
query("misconfig_checks", "SELECT id AS \"check\", count(DISTINCT image) AS images FROM {findings} WHERE category = 'image-config' GROUP BY 1")(lambda s, d: ops.misconfigs(views.findings(s, d)))
query("severe_by_ecosystem", f"SELECT {CLASS} AS class, {ECO} AS ecosystem, count(*) AS n FROM {{findings}} WHERE category = 'pkg-vuln' AND severity IN ('high', 'critical') GROUP BY 1, 2")(lambda s, d: ops.severe_by_ecosystem(views.findings(s, d)))
query("codetection_groups", f"SELECT image, cve, package, CAST(mask AS INTEGER) AS mask, CAST(rank AS INTEGER) AS rank, CAST(coalesce(rank_trivy, -1) AS INTEGER) AS rank_trivy, CAST(coalesce(rank_grype, -1) AS INTEGER) AS rank_grype, CAST(coalesce(rank_osv, -1) AS INTEGER) AS rank_osv, ecosystem FROM {GROUPS}")(lambda s, d: groups(s, d).fillna(-1, ["rank_trivy", "rank_grype", "rank_osv"]))
query("venn_regions", f"SELECT CAST(mask AS INTEGER) AS mask, count(*) AS n, CAST(bit_count(mask) AS INTEGER) AS n_scanners FROM {GROUPS} GROUP BY mask")(lambda s, d: agreement.by_mask(groups(s, d)))
_SETS = {"trivy": 1, "grype": 2, "osv": 4, "trivy+grype": 3, "trivy+osv": 5, "grype+osv": 6, "trivy+grype+osv": 7}
query("scanner_coverage", " UNION ALL ".join(f"SELECT '{k}' AS scanners, count(*) FILTER ((mask & {m}) <> 0) AS n, round(count(*) FILTER ((mask & {m}) <> 0) * 100.0E0 / count(*), 6) AS pct FROM {GROUPS}" for k, m in _SETS.items()))(
    lambda s, d: agreement.coverage(agreement.by_mask(groups(s, d))).withColumn("pct", F.round("pct", 6))
)
query(
    "marginal_gain",
    f"""WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS total, {", ".join(f"CAST(count(*) FILTER ((mask & {m}) <> 0) AS DOUBLE) AS c{m}" for m in range(1, 8))} FROM {GROUPS}),
 g AS (SELECT total, (c1 + c2 + c4) / 3 AS g1, ((c3 - c1) + (c5 - c1) + (c3 - c2) + (c6 - c2) + (c5 - c4) + (c6 - c4)) / 6 AS g2, ((c7 - c3) + (c7 - c5) + (c7 - c6)) / 3 AS g3 FROM c)
 SELECT 1 AS k, round(g1, 6) AS gain, round(g1 * 100 / total, 6) AS pct, round(g1 * 100 / total, 6) AS cumulative_pct FROM g UNION ALL SELECT 2, round(g2, 6), round(g2 * 100 / total, 6), round((g1 + g2) * 100 / total, 6) FROM g UNION ALL SELECT 3, round(g3, 6), round(g3 * 100 / total, 6), round((g1 + g2 + g3) * 100 / total, 6) FROM g""",
)(lambda s, d: agreement.marginal(agreement.by_mask(groups(s, d))).select("k", *(F.round(c, 6).alias(c) for c in ("gain", "pct", "cumulative_pct"))))
for _what, _key in (("severity", NAME.format(r="rank")), ("class", CLASS)):
    query(f"agreement_by_{_what}", f"SELECT {_key} AS {_what}, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (bit_count(mask) = {k}) * 100.0E0 / count(*), 6) AS {x}" for k, x in ((1, "single"), (2, "two"), (3, "three"))) + f" FROM {GROUPS} GROUP BY 1")(
        lambda s, d, w=_what: agreement.agreement_by(groups(s, d), w).select(w, "n", *(F.round(c, 6).alias(c) for c in ("single", "two", "three")))
    )
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {NAME.format(r=f'rank_{a}')} AS severity_a, {NAME.format(r=f'rank_{b}')} AS severity_b FROM {GROUPS} WHERE rank_{a} IS NOT NULL AND rank_{b} IS NOT NULL" for a, b in (("trivy", "grype"), ("trivy", "osv"), ("grype", "osv")))
query("severity_confusion", f"SELECT a, b, severity_a, severity_b, count(*) AS n FROM ({_PAIRS}) GROUP BY ALL")(lambda s, d: agreement.confusion(groups(s, d)))
query("severity_mismatch", f"SELECT a, b, count(*) AS n, round(count(*) FILTER (severity_a <> severity_b) * 100.0E0 / count(*), 6) AS mismatch_pct FROM ({_PAIRS}) GROUP BY ALL")(lambda s, d: agreement.mismatch(agreement.confusion(groups(s, d))).withColumn("mismatch_pct", F.round("mismatch_pct", 6)))
query("findings_against_groups", f"""SELECT f.severity, f.findings, coalesce(g.groups, 0) AS groups, round(CAST(f.findings AS DOUBLE) / g.groups, 6) AS ratio FROM (SELECT severity, count(*) AS findings FROM {{findings}} WHERE category = 'pkg-vuln' GROUP BY 1) f
 LEFT JOIN (SELECT {NAME.format(r="rank")} AS severity, count(*) AS groups FROM {GROUPS} GROUP BY 1) g USING (severity)""")(lambda s, d: agreement.all_and_distinct(views.findings(s, d), groups(s, d)).withColumn("ratio", F.round("ratio", 6)))
PER_CVE = f"""WITH f AS (SELECT * FROM {{findings}} WHERE category = 'pkg-vuln' AND id LIKE 'CVE-%'),
 im AS (SELECT image, exposure, dependency_weight, downstream, row_number() OVER (PARTITION BY CASE WHEN digest = '' THEN '#' || CAST(image AS VARCHAR) ELSE digest END ORDER BY image) = 1 AS fst FROM {{images}}),
 p AS (SELECT DISTINCT id, image FROM f), s AS (SELECT id, count(*) AS images, CAST(sum(exposure) AS BIGINT) AS exposure, count(*) FILTER (fst) AS digests, CAST(coalesce(sum(CASE WHEN fst THEN dependency_weight END), 0) AS BIGINT) AS dependency_weight,
  CAST(coalesce(sum(CASE WHEN fst THEN downstream END), 0) AS BIGINT) AS downstream FROM p JOIN im USING (image) GROUP BY id),
 w AS (SELECT id, max({RANK}) AS rank, arg_min(package, (-{RANK}, seq, package)) AS package FROM f GROUP BY id)
 SELECT id, images, exposure, digests, dependency_weight, downstream, {NAME.format(r="rank")} AS worst, package FROM s JOIN w USING (id)"""
query("cve_exposure", PER_CVE)(lambda s, d: ops.per_cve(views.findings(s, d), views.images(s, d)))
query("top_cves_by_exposure", f"SELECT * FROM ({PER_CVE}) ORDER BY exposure DESC, id LIMIT 20")(lambda s, d: ops.per_cve(views.findings(s, d), views.images(s, d)).orderBy(F.col("exposure").desc(), "id").limit(20))
query("top_cves_by_digests_then_downstream", f"SELECT * FROM (SELECT * FROM ({PER_CVE}) ORDER BY digests DESC, id LIMIT 25) ORDER BY downstream DESC, id")(
    lambda s, d: ops.per_cve(views.findings(s, d), views.images(s, d)).orderBy(F.col("digests").desc(), "id").limit(25).orderBy(F.col("downstream").desc(), "id")
)
query("top_packages", f"SELECT {PKG} AS name, count(*) AS n FROM {{findings}} WHERE category = 'pkg-vuln' GROUP BY 1 ORDER BY n DESC, name LIMIT 25")(
    lambda s, d: search.top(views.findings(s, d).where("category = 'pkg-vuln'").withColumn("name", ops.package_name(F.col("package"))), "name", 25)
)
query("cve_digests", "WITH i AS (SELECT image, digest FROM {images} WHERE digest <> ''), f AS (SELECT DISTINCT id, image FROM {findings} WHERE id LIKE 'CVE-%') SELECT id, count(DISTINCT digest) AS n_digests, md5(string_agg(DISTINCT digest, ',' ORDER BY digest)) AS digests_md5 FROM f JOIN i USING (image) GROUP BY id ORDER BY n_digests DESC, id LIMIT 30")(lambda s, d: ops.top_digests(views.findings(s, d), views.images(s, d), 30))


def raw(spark, sf_dir):
    """Findings with a target, for the merge."""
    return views.findings(spark, sf_dir).select(
        "*", F.concat(F.lit("img"), F.col("image").cast("string")).alias("target_name"), F.lit("").alias("version"), F.concat(F.lit("/p"), (F.col("seq") % 2).cast("string")).alias("location"), F.when(F.col("seq") % 3 == 0, "10.0.0.1").alias("target_ip"),
        F.lit("").alias("endpoint"), F.when(F.col("seq") % 4 == 0, F.concat(F.lit("fix"), (F.col("seq") % 100).cast("string"))).otherwise("").alias("fixed_version"), F.array(F.concat(F.lit("http://x/"), (F.col("seq") % 5).cast("string"))).alias("references"),
    ).withColumn("cves", F.when(F.col("id").startswith("CVE"), F.array(F.lower("id"))).otherwise(F.array().cast("array<string>")))


def merged(spark, sf_dir):
    """Merged findings, likewise."""
    return fresh(spark, "merged", [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part")], lambda: ops.merged(raw(spark, sf_dir)), (ops, severity, views, sys.modules[__name__]))


MERGED = f"""(SELECT any_value(category) AS category, {NAME.format(r=f"max({RANK})")} AS severity, max(cvss) AS cvss, list_sort(list_distinct(list(scanner))) AS found_by, count(*) AS n_raw,
 any_value(lower(id)) AS lid, any_value('img' || CAST(image AS VARCHAR)) AS target_name, list_sort(list_distinct(list('http://x/' || CAST(seq % 5 AS VARCHAR)))) AS refs, arg_min(CASE WHEN seq % 4 = 0 THEN 'fix' || CAST(seq % 100 AS VARCHAR) END, seq) FILTER (seq % 4 = 0) AS fixed_version,
 max(CASE WHEN seq % 3 = 0 THEN '10.0.0.1' END) AS target_ip FROM {{findings}} GROUP BY image, category, lower(id), lower(package), seq % 2)"""
query("merged_findings", f"SELECT target_name, category, lid AS id, severity, cvss, array_to_string(found_by, ',') AS found_by, CAST(len(found_by) AS INTEGER) AS n_scanners, n_raw, array_to_string(refs, ',') AS refs, fixed_version, target_ip FROM {MERGED}")(
    lambda s, d: merged(s, d).select("target_name", "category", F.lower("id").alias("id"), "severity", "cvss", F.array_join("found_by", ",").alias("found_by"), "n_scanners", "n_raw", F.array_join("references", ",").alias("refs"), "fixed_version", "target_ip")
)
query("merged_agreement_histogram", f"SELECT CAST(least(len(found_by), 4) AS INTEGER) AS scanners, count(*) AS n FROM {MERGED} GROUP BY 1")(lambda s, d: ops.agreement_histogram(merged(s, d)))
query("scanner_jaccard", f"""WITH m AS (SELECT found_by FROM {MERGED}), c AS (SELECT a.s AS a, b.s AS b, count(*) FILTER (list_contains(found_by, a.s) AND list_contains(found_by, b.s)) AS n_both, count(*) FILTER (list_contains(found_by, a.s) OR list_contains(found_by, b.s)) AS any_
 FROM m, (VALUES ('grype'), ('osv'), ('trivy')) a(s), (VALUES ('grype'), ('osv'), ('trivy')) b(s) WHERE a.s < b.s GROUP BY 1, 2) SELECT a, b, n_both, round(CAST(n_both AS DOUBLE) / any_, 6) AS jaccard FROM c WHERE n_both > 0""")(lambda s, d: ops.jaccard(merged(s, d)).withColumn("jaccard", F.round("jaccard", 6)))
query("exclusive_findings", f"SELECT scanner, count(*) AS merged, count(*) FILTER (n = 1) AS exclusive, count(*) FILTER (n = 1 AND severity NOT IN ('info', 'unknown')) AS exclusive_meaningful FROM (SELECT unnest(found_by) AS scanner, len(found_by) AS n, severity FROM {MERGED}) GROUP BY 1")(lambda s, d: ops.exclusive(merged(s, d)))
query("severity_by_category", "SELECT category, severity, count(*) AS n, CAST(grouping(category, severity) AS BIGINT) AS level FROM {findings} GROUP BY ROLLUP (category, severity)")(lambda s, d: ops.severity_by_category(views.findings(s, d)))
query("coverage_matrix", "SELECT category, " + ", ".join(f"count(*) FILTER (scanner = '{x}') AS {x}" for x in ops.SCANNERS) + " FROM {findings} GROUP BY category")(lambda s, d: views.findings(s, d).groupBy("category").pivot("scanner", list(ops.SCANNERS)).agg(F.count(F.lit(1))).fillna(0))
query("osv_backfill", "SELECT CASE WHEN scanner = 'osv' AND category = 'pkg-vuln' AND severity = 'unknown' THEN coalesce(CASE WHEN CAST(right(id, 2) AS INTEGER) % 3 = 0 THEN 'high' END, severity) ELSE severity END AS severity, count(*) AS n FROM {findings} GROUP BY 1")(
    lambda s, d: ops.counts(ops.corrected(views.findings(s, d), views.findings(s, d).select("id", F.lit("high").alias("severity"), "seq").where(F.substring("id", -2, 2).cast("int") % 3 == 0)), "severity")
)
query("merged_order", f"SELECT target_name, lid AS id, category, severity, cvss FROM {MERGED} ORDER BY {RANK} DESC, cvss DESC, target_name, lid, category, array_to_string(found_by, ','), n_raw DESC")(
    lambda s, d: merged(s, d).select("target_name", F.lower("id").alias("id"), "category", "severity", "cvss", "found_by", "n_raw").orderBy(ops.severity_rank(F.col("severity")).desc(), F.col("cvss").desc(), "target_name", "id", "category", F.array_join("found_by", ","), F.col("n_raw").desc()).drop("found_by", "n_raw")
)
query("recent_cve_share", "SELECT round(count(DISTINCT CASE WHEN CAST(regexp_extract(id, '^CVE-(\\d{4})-\\d+', 1) AS INTEGER) >= 2020 THEN id END) * 100.0E0 / count(DISTINCT id), 6) AS pct FROM {findings} WHERE id LIKE 'CVE-%'")(
    lambda s, d: ops.cves_by_year(views.findings(s, d)).agg(F.round(F.sum(F.when(F.col("year") >= 2020, F.col("cves"))) * 100.0 / F.sum("cves"), 6).alias("pct"))
)
query("severity_containers", "WITH c AS (SELECT i.image, count(f.severity) AS n FROM {images} i LEFT JOIN (SELECT image, severity FROM {findings} WHERE severity IN ('critical', 'high')) f ON f.image = i.image GROUP BY i.image) SELECT CASE WHEN n >= 30 THEN '30+' WHEN n >= 20 THEN '20-29' WHEN n >= 10 THEN '10-19' WHEN n >= 5 THEN '5-9' WHEN n >= 1 THEN '1-4' ELSE '0' END AS bin, count(*) AS images FROM c GROUP BY 1")(
    lambda s, d: ops.severe_bins(views.images(s, d), views.findings(s, d))
)
query("most_exposed_images", "SELECT image, count(*) FILTER (severity = 'critical') * 4 + count(*) FILTER (severity = 'high') AS score FROM {findings} GROUP BY image ORDER BY score DESC, image LIMIT 25")(
    lambda s, d: views.findings(s, d).groupBy("image").agg((F.count_if(F.col("severity") == "critical") * 4 + F.count_if(F.col("severity") == "high")).alias("score")).orderBy(F.col("score").desc(), "image").limit(25)
)
query("container_scanner_json", "SELECT image, scanner, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l, count(*) FILTER (severity = 'info') AS i, count(*) FILTER (severity = 'unknown') AS u FROM {findings} GROUP BY image, scanner")(
    lambda s, d: views.findings(s, d).groupBy("image", "scanner").agg(*(F.count(F.when(F.col("severity") == x, 1)).alias(x[0]) for x in ops.SEVERITIES))
)
query("rescan_selector", "SELECT image, count(*) AS n FROM {findings} WHERE severity = 'unknown' GROUP BY image HAVING count(*) >= 5")(lambda s, d: ops.counts(views.findings(s, d).where("severity = 'unknown'"), "image").where("n >= 5"))
query("unknown_osv_ids", "SELECT id, count(DISTINCT image) AS images FROM {findings} WHERE scanner = 'osv' AND severity = 'unknown' AND category = 'pkg-vuln' GROUP BY id")(lambda s, d: views.findings(s, d).where("scanner = 'osv' AND severity = 'unknown' AND category = 'pkg-vuln'").groupBy("id").agg(F.count_distinct("image").alias("images")))
query("source_tables", "SELECT 'lineitem' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")(
    lambda s, d: table(s, d, "lineitem").agg(F.lit("lineitem").alias("name"), F.count(F.lit(1)).alias("n")).unionAll(table(s, d, "orders").agg(F.lit("orders"), F.count(F.lit(1)))).unionAll(table(s, d, "part").agg(F.lit("part"), F.count(F.lit(1))))
)
