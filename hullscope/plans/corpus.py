"""Queries on scanner runs, nested catalogue documents, projections and report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.severity import severity_rank
from ..operators import findings as ops
from ..operators import search
from ..sources.readers import table
from . import views
from .registry import query

RUNS = """SELECT 's' || CAST(o_custkey % 6 AS VARCHAR) AS scanner, o_custkey AS target, CASE WHEN o_orderkey % 11 = 0 THEN 'error: x' WHEN o_orderkey % 13 = 0 THEN 'timeout' WHEN o_orderkey % 17 = 0 THEN 'skipped' WHEN o_orderkey % 5 = 0 THEN 'nonzero-ok' ELSE 'ok' END AS status,
 CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE o_totalprice / 1000 END AS wall_seconds, CAST(o_orderkey % 900 AS DOUBLE) AS peak_mem_mb, o_orderdate AS started_at, o_orderdate + to_seconds(CAST(o_orderkey % 400 AS BIGINT) - 20) AS finished_at FROM orders"""
views.SQL["runs"] = RUNS


def runs(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    started = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        F.concat(F.lit("s"), (F.col("o_custkey") % 6).cast("string")).alias("scanner"), F.col("o_custkey").alias("target"), F.when(k % 11 == 0, "error: x").when(k % 13 == 0, "timeout").when(k % 17 == 0, "skipped").when(k % 5 == 0, "nonzero-ok").otherwise("ok").alias("status"),
        F.when(k % 19 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / 1000).alias("wall_seconds"), (k % 900).cast("double").alias("peak_mem_mb"), started.alias("started_at"), (started + k % 400 - 20).alias("finished_at"),
    )


OK = "(status LIKE 'ok%' OR status LIKE 'nonzero-ok%')"
query("invocations_by_status", "SELECT scanner, status, count(*) AS n FROM {runs} GROUP BY ALL")(lambda s, d: ops.counts(runs(s, d), "scanner", "status"))
query("wall_seconds_by_scanner", "SELECT scanner, count(*) AS n, round(avg(wall_seconds), 4) AS mean, round(quantile_cont(wall_seconds, 0.5), 6) AS median, max(wall_seconds) AS longest FROM {runs} WHERE wall_seconds > 0 GROUP BY scanner")(
    lambda s, d: runs(s, d).where("wall_seconds > 0").groupBy("scanner").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("wall_seconds"), 4).alias("mean"), F.round(F.percentile("wall_seconds", 0.5), 6).alias("median"), F.max("wall_seconds").alias("longest"))
)
query("scan_durations", "SELECT CAST(epoch(finished_at) - epoch(started_at) AS BIGINT) AS seconds, count(*) AS n FROM {runs} WHERE finished_at >= started_at GROUP BY 1")(lambda s, d: ops.counts(runs(s, d).where("finished_at >= started_at").withColumn("seconds", F.col("finished_at") - F.col("started_at")), "seconds"))
_P = lambda q: f"max(CASE WHEN i = CAST(round_even((n - 1) * {q}E0, 0) AS BIGINT) THEN wall_seconds END)"
query(
    "scanner_table",
    f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY scanner ORDER BY wall_seconds) - 1 AS i, count(*) OVER (PARTITION BY scanner) AS n FROM {{runs}})
 SELECT scanner, count(*) AS runs, count(*) FILTER (WHERE {OK}) AS ok, count(*) FILTER (status LIKE 'error%') AS errors, count(*) FILTER (status LIKE 'timeout%') AS timeouts, count(*) FILTER (status LIKE 'skip%') AS skips, round(avg(wall_seconds), 4) AS avg_seconds, max(peak_mem_mb) AS peak_mem_mb, {_P("0.5")} AS p50, {_P("0.95")} AS p95 FROM x GROUP BY scanner""",
)(lambda s, d: ops.invocation_table(runs(s, d)).withColumn("avg_seconds", F.round("avg_seconds", 4)))
query("run_success_rate", f"SELECT round(count(*) FILTER (WHERE {OK}) * 100.0E0 / count(*), 6) AS pct FROM {{runs}}")(lambda s, d: runs(s, d).agg(F.round(F.count_if(F.col("status").startswith("ok") | F.col("status").startswith("nonzero-ok")) * 100.0 / F.count(F.lit(1)), 6).alias("pct")))
query("corpus_throughput", "SELECT CAST(epoch(max(finished_at)) - epoch(min(started_at)) AS BIGINT) AS span_s, count(DISTINCT target) AS targets, round(count(DISTINCT target) * 3600.0E0 / (epoch(max(finished_at)) - epoch(min(started_at))), 6) AS per_hour, round(sum(wall_seconds) / (epoch(max(finished_at)) - epoch(min(started_at))), 6) AS parallelism FROM {runs}")(
    lambda s, d: runs(s, d).agg((F.max("finished_at") - F.min("started_at")).alias("span_s"), F.count_distinct("target").alias("targets"), F.sum("wall_seconds").alias("w")).select("span_s", "targets", F.round(F.col("targets") * 3600.0 / F.col("span_s"), 6).alias("per_hour"), F.round(F.col("w") / F.col("span_s"), 6).alias("parallelism"))
)
query("scanner_target_matrix", "SELECT target, scanner, count(*) AS runs, max(peak_mem_mb) AS mem, round(avg(wall_seconds), 4) AS wall FROM {runs} GROUP BY ALL")(lambda s, d: runs(s, d).groupBy("target", "scanner").agg(F.count(F.lit(1)).alias("runs"), F.max("peak_mem_mb").alias("mem"), F.round(F.avg("wall_seconds"), 4).alias("wall")))
query("error_retargets", "SELECT target FROM {runs} WHERE status LIKE 'error%' GROUP BY target HAVING count(*) >= 2")(lambda s, d: ops.counts(runs(s, d).where("startswith(status, 'error')"), "target").where("n >= 2").select("target"))


def nested(s, d):
    """Orders as tags with an array of images."""
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("tag")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("digest"), F.col("l_linenumber").alias("size")))).alias("images"))


query("tags_with_digest", "SELECT DISTINCT l_orderkey AS tag FROM lineitem WHERE l_partkey = 7")(lambda s, d: nested(s, d).where(F.exists("images", lambda x: x["digest"] == 7)).select("tag"))
query("exploded_references", "SELECT l_orderkey AS tag, count(*) AS images, CAST(sum(l_linenumber) AS BIGINT) AS total, max(l_linenumber) AS most FROM lineitem GROUP BY l_orderkey")(
    lambda s, d: nested(s, d).select("tag", F.explode("images").alias("i")).groupBy("tag").agg(F.count(F.lit(1)).alias("images"), F.sum("i.size").alias("total"), F.max("i.size").alias("most"))
)
query("array_slices", "SELECT l_orderkey AS tag, least(count(*), 10) AS kept, min(l_partkey) AS first_digest FROM lineitem GROUP BY l_orderkey")(lambda s, d: nested(s, d).select("tag", F.size(F.slice("images", 1, 10)).cast("bigint").alias("kept"), F.try_element_at("images", F.lit(1))["digest"].alias("first_digest")))
query("numeric_guard", "SELECT count(*) AS n, CAST(sum(TRY_CAST(v AS DOUBLE)) AS BIGINT) AS total FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS v FROM orders) WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL")(
    lambda s, d: table(s, d, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string")).try_cast("double").alias("v")).where("v IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("bigint").alias("total"))
)
query("not_in_levels", "SELECT severity, count(*) AS n FROM {findings} WHERE severity NOT IN ('info', 'unknown') GROUP BY severity")(lambda s, d: ops.counts(views.findings(s, d).where(~F.col("severity").isin("info", "unknown")), "severity"))
query("truncated_fields", "SELECT page_id, substr(html, 1, 300) AS html, substr(url, 1, 20) AS url FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", F.substring("html", 1, 300).alias("html"), F.substring("url", 1, 20).alias("url")))
query("short_codes", "SELECT substr(severity, 1, 1) AS code, count(*) AS n FROM {findings} GROUP BY 1")(lambda s, d: ops.counts(views.findings(s, d).withColumn("code", F.substring("severity", 1, 1)), "code"))
query("case_insensitive_filter", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'r#00000001') AND c_mktsegment = 'BUILDING'")(lambda s, d: table(s, d, "customer").where(search.containing("c_name", "R#00000001") & search.equal_filters(c_mktsegment="BUILDING", c_phone="")).select("c_custkey"))
query("json_documents", "SELECT event_type, CAST(sum(CAST(props->>'$.k' AS INTEGER)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.sum(F.variant_get(F.parse_json("props"), "$.k", "int")).alias("k"), F.count(F.lit(1)).alias("n")))
query("compact_json", """SELECT r_regionkey, '{"key":' || CAST(r_regionkey AS VARCHAR) || ',"name":"' || r_name || '"}' AS doc FROM region""")(lambda s, d: table(s, d, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))).alias("doc")))
query("hash_keys", "SELECT image, sha256(coalesce(digest, '')) AS sha, md5(repo || ':' || tag) AS key FROM {images}")(lambda s, d: views.images(s, d).select("image", F.sha2(F.coalesce("digest", F.lit("")).cast("binary"), 256).alias("sha"), F.md5(F.concat("repo", F.lit(":"), "tag").cast("binary")).alias("key")))
query("set_operations", "(SELECT image FROM {findings} WHERE scanner = 'trivy' INTERSECT SELECT image FROM {findings} WHERE scanner = 'grype') EXCEPT SELECT image FROM {findings} WHERE scanner = 'osv' AND severity = 'critical'")(
    lambda s, d: views.findings(s, d).where("scanner = 'trivy'").select("image").intersect(views.findings(s, d).where("scanner = 'grype'").select("image")).subtract(views.findings(s, d).where("scanner = 'osv' AND severity = 'critical'").select("image"))
)
query("running_rank", "SELECT image, pull, row_number() OVER (PARTITION BY ns ORDER BY exposure DESC, image) AS position FROM {images}")(
    lambda s, d: views.images(s, d).select("image", "pull", F.row_number().over(Window.partitionBy("ns").orderBy(F.col("exposure").desc(), "image")).cast("bigint").alias("position"))
)
query("worst_first_package", "SELECT image, max(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) AS rank, count(DISTINCT lower(list_extract(string_split(split_part(package, '@', 1), '/'), -1))) AS packages FROM {findings} GROUP BY image")(
    lambda s, d: views.findings(s, d).groupBy("image").agg(F.max(severity_rank(F.col("severity"))).alias("rank"), F.count_distinct(tx.package_name(F.col("package"))).alias("packages"))
)
query("table_values", "SELECT 'findings' AS token, CAST(count(*) AS VARCHAR) AS value FROM {findings} UNION ALL SELECT 'images', CAST(count(*) AS VARCHAR) FROM {images} UNION ALL SELECT 'critical_pct', printf('%.1f', count(*) FILTER (severity = 'critical') * 100.0E0 / count(*)) FROM {findings}")(
    lambda s, d: views.findings(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("c")).select(F.inline(F.array(F.struct(F.lit("findings").alias("token"), F.col("n").cast("string").alias("value")), F.struct(F.lit("critical_pct").alias("token"), F.format_string("%.1f", tx.percent(F.col("c"), F.col("n"))).alias("value")))))
    .unionByName(views.images(s, d).agg(F.lit("images").alias("token"), F.count(F.lit(1)).cast("string").alias("value")))
)
