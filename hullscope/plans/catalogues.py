"""Queries on joins, filters, projections, the work queue, events, search and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import text as tx
from ..operators import catalogue, queue, rules, search
from ..operators.checkpoint import kept
from ..operators.findings import counts, filled_counts
from ..sources.readers import table
from ..streaming import events as ev
from . import views
from .registry import query

I, J, FI = views.images, views.jobs, views.findings
RK = "SELECT ns, repo, tag, arg_min(exposure, seq) AS exposure FROM (SELECT ns, repo, tag, exposure, image AS seq FROM {images} WHERE image % 3 = 0) GROUP BY ns, repo, tag"

query("ranked_report_join", f"SELECT i.image, CAST(CASE WHEN k.ns IS NOT NULL THEN k.exposure ELSE i.exposure END AS BIGINT) AS exposure, k.ns IS NOT NULL AS matched FROM {{images}} i LEFT JOIN ({RK}) k USING (ns, repo, tag)")(
    lambda s, d: catalogue.ranked_reports(I(s, d), I(s, d).where("image % 3 = 0").withColumn("seq", F.col("image")), ["ns", "repo", "tag"], ["exposure"]).select("image", "exposure", "matched")
)
query("last_updated_join", "SELECT i.image, CAST(u.updated AS VARCHAR) AS last_updated FROM {images} i LEFT JOIN (SELECT lower(ns) AS ns, lower(repo) AS repo, tag, max(updated) AS updated FROM {images} WHERE image % 2 = 0 GROUP BY 1, 2, 3) u ON lower(i.ns) = u.ns AND lower(i.repo) = u.repo AND i.tag = u.tag")(
    lambda s, d: I(s, d).select("image", F.lower("ns").alias("ns"), F.lower("repo").alias("repo"), "tag").join(I(s, d).where("image % 2 = 0").groupBy(F.lower("ns").alias("ns"), F.lower("repo").alias("repo"), "tag").agg(F.max("updated").alias("u")), ["ns", "repo", "tag"], "left").select("image", F.date_format("u", "yyyy-MM-dd HH:mm:ss").alias("last_updated"))
)
query("corpus_filter", "SELECT image, pull FROM {images} WHERE repo || ':' || tag IN (SELECT repo || ':' || tag FROM {images} ORDER BY exposure DESC, image LIMIT 1000)")(
    lambda s, d: I(s, d).withColumn("rt", F.concat("repo", F.lit(":"), "tag")).join(F.broadcast(I(s, d).orderBy(F.col("exposure").desc(), "image").limit(1000).select(F.concat("repo", F.lit(":"), "tag").alias("rt")).distinct()), "rt", "left_semi").select("image", "pull")
)
query("digest_filter", "SELECT image FROM {images} WHERE digest IN (SELECT digest FROM {images} WHERE image % 10 = 0 AND digest <> '')")(lambda s, d: I(s, d).join(I(s, d).where("image % 10 = 0 AND digest <> ''").select("digest").distinct(), "digest", "left_semi").select("image"))
query("tag_completeness", "SELECT 't' || CAST(l_orderkey % 300 AS VARCHAR) AS tag, bool_and(coalesce(p_size > 10, false)) AS complete, count(*) AS digests FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 7 <> 0 WHERE l_linenumber = 1 GROUP BY 1")(
    lambda s, d: catalogue.complete_tags(table(s, d, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("t"), (F.col("l_orderkey") % 300).cast("string")).alias("tag"), F.col("l_partkey").alias("digest")), table(s, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("digest"), (F.col("p_size") - 10).alias("layers")))
)
query("network_services", "SELECT i.image, c.c_name AS repository, n.n_name AS region FROM {images} i LEFT JOIN customer c ON c.c_custkey = i.downstream AND c.c_custkey % 3 = 0 LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey < 20 WHERE i.pull > 400000 ORDER BY i.pull DESC, i.image LIMIT 500")(
    lambda s, d: I(s, d).where("pull > 400000").join(table(s, d, "customer").where("c_custkey % 3 = 0"), F.col("downstream") == F.col("c_custkey"), "left").join(table(s, d, "nation").where("n_nationkey < 20"), F.col("n_nationkey") == F.col("c_nationkey"), "left").orderBy(F.col("pull").desc(), "image").limit(500).select("image", F.col("c_name").alias("repository"), F.col("n_name").alias("region"))
)
query("address_join", "SELECT l_suppkey AS addr, coalesce(s_name, 'ip_' || CAST(l_suppkey AS VARCHAR)) AS target, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 2 = 0 GROUP BY 1, 2")(
    lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("addr")).agg(F.count(F.lit(1)).alias("n")).join(table(s, d, "supplier").where("s_suppkey % 2 = 0"), F.col("addr") == F.col("s_suppkey"), "left").select("addr", F.coalesce("s_name", F.concat(F.lit("ip_"), F.col("addr").cast("string"))).alias("target"), "n")
)
query("reweigh_changes", "SELECT j.id, j.weight AS old_weight, n.new_weight FROM {jobs} j JOIN (SELECT image AS id, max(CAST(pull // 1001 AS DOUBLE)) AS new_weight FROM {images} GROUP BY image) n USING (id) WHERE abs(j.weight - n.new_weight) >= 1")(
    lambda s, d: catalogue.reweigh(J(s, d), I(s, d).select(F.col("image").alias("id"), F.floor(F.col("pull") / 1001).cast("double").alias("exposure")), ["id"])
)
query("prior_findings_union", "SELECT scanner, count(*) AS n FROM (SELECT scanner FROM {findings} WHERE seq % 2 = 0 AND scanner NOT IN (SELECT scanner FROM {findings} WHERE seq % 2 = 1 AND scanner <> 'osv') UNION ALL SELECT scanner FROM {findings} WHERE seq % 2 = 1 AND scanner <> 'osv') GROUP BY scanner")(
    lambda s, d: counts(queue.merged_passes(FI(s, d).where("seq % 2 = 0"), FI(s, d).where("seq % 2 = 1 AND scanner <> 'osv'"), ["scanner"]), "scanner")
)
query("new_targets", "SELECT image FROM {images} WHERE image % 4 = 0 AND image NOT IN (SELECT id FROM {jobs} WHERE status = 'done')")(lambda s, d: I(s, d).where("image % 4 = 0").select("image").join(J(s, d).where("status = 'done'").select(F.col("id").alias("image")), "image", "left_anti"))
query("host_preference", "SELECT o_custkey AS target, o_orderstatus AS host, o_orderkey AS run FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_totalprice > 250000) DESC, o_orderstatus, o_orderkey) AS k FROM orders) WHERE k = 1")(
    lambda s, d: catalogue.preferred(table(s, d, "orders"), ["o_custkey"], F.col("o_totalprice") > 250000, [F.col("o_orderstatus"), F.col("o_orderkey")]).select(F.col("o_custkey").alias("target"), F.col("o_orderstatus").alias("host"), F.col("o_orderkey").alias("run"))
)
query("first_row_per_digest", "SELECT digest, min(image) AS image FROM {images} WHERE digest <> '' GROUP BY digest")(lambda s, d: catalogue.first_by(I(s, d).where("digest <> ''").select("digest", "image"), ["digest"], [F.col("image")]))
query("newest_tags", "SELECT ns, repo, tag, image FROM (SELECT *, row_number() OVER (PARTITION BY ns, repo ORDER BY updated DESC, image) AS k FROM {images}) WHERE k <= 3 OR lower(trim(ns)) IN ('', 'library')")(lambda s, d: catalogue.newest_tags(I(s, d), 3).select("ns", "repo", "tag", "image"))
query("graph_tags", "SELECT DISTINCT * FROM (SELECT ns, repo, arg_max(tag, (updated, image)) AS tag FROM {images} GROUP BY ns, repo UNION ALL SELECT ns, repo, tag FROM {images} WHERE tag = 'latest')")(lambda s, d: catalogue.graph_tags(I(s, d)))
query("stale_images", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate > TIMESTAMP '1998-01-01' + to_days(CAST(c_nationkey * 30 AS INTEGER)) OR TIMESTAMP '1998-01-01' + to_days(CAST(c_nationkey * 30 AS INTEGER)) > TIMESTAMP '1999-06-01'")(
    lambda s, d: catalogue.stale(table(s, d, "orders").join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.to_date("o_orderdate").alias("c"), F.date_add(F.lit("1998-01-01").cast("date"), (F.col("c_nationkey") * 30).cast("int")).alias("p"), F.lit("1999-06-01").cast("date").alias("u")), "c", "p", "u").select("o_orderkey")
)
query("same_digest_groups", "SELECT md5(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")(
    lambda s, d: table(s, d, "documents").groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
)

query("queue_stats", "SELECT s AS status, count(status) AS n FROM (VALUES ('pending'), ('running'), ('done'), ('failed'), ('skipped')) v(s) LEFT JOIN {jobs} ON status = s GROUP BY s")(lambda s, d: filled_counts(J(s, d), "status", queue.STATUSES))
query("queue_claim_order", "SELECT id, weight FROM {jobs} WHERE status = 'pending' ORDER BY weight DESC, id LIMIT 50")(lambda s, d: queue.next_pending(J(s, d), 50).select("id", "weight"))


def job_rows(s, d):
    none = lambda t: F.lit(None).cast(t)
    return J(s, d).select("id", "image", "image", none("string").alias("target_json"), "weight", "status", F.lit("w0").alias("worker_id"), "attempts", none("string").alias("error"), F.lit(0.0).alias("created_at"), "started_at", "heartbeat_at", none("double").alias("finished_at")).toDF("id", "image", "name", "target_json", "weight", "status", "worker_id", "attempts", "error", "created_at", "started_at", "heartbeat_at", "finished_at")


query("queue_claim", "SELECT id, CASE WHEN k <= 10 THEN 'running' ELSE status END AS status, CAST(CASE WHEN k <= 10 THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts FROM (SELECT id, status, attempts, CASE WHEN status = 'pending' THEN row_number() OVER (PARTITION BY status ORDER BY weight DESC, id) END AS k FROM {jobs})")(lambda s, d: queue.claim(job_rows(s, d), "w1", 10, 1000.0).select("id", "status", "attempts"))
query("queue_reclaim_stale", "SELECT id, CASE WHEN status = 'running' AND coalesce(heartbeat_at, started_at) < 2000 - 1000 THEN 'pending' ELSE status END AS status FROM {jobs}")(lambda s, d: queue.reclaim_stale(job_rows(s, d), 2000.0, 1000.0).select("id", "status"))
query("queue_trim", "SELECT id FROM {jobs} WHERE status <> 'pending' OR weight >= (SELECT weight FROM {jobs} WHERE status = 'pending' ORDER BY weight DESC, id LIMIT 1 OFFSET 99)")(lambda s, d: queue.trimmed(J(s, d), 100).select("id"))
query("queue_reweighted", "SELECT j.id, coalesce(w, weight) AS weight FROM {jobs} j LEFT JOIN (SELECT 'img' || CAST(image AS VARCHAR) AS image, max(CAST(exposure AS DOUBLE)) AS w FROM {images} WHERE image % 2 = 0 GROUP BY 1) r USING (image)")(
    lambda s, d: queue.reweighted(J(s, d), I(s, d).where("image % 2 = 0").select(F.concat(F.lit("img"), F.col("image").cast("string")).alias("image"), F.col("exposure").cast("double").alias("weight"))).select("id", "weight")
)
query("queue_seed", "SELECT image, status FROM (SELECT image, status FROM {jobs} UNION ALL SELECT 'new' || CAST(p_partkey AS VARCHAR), 'pending' FROM part)")(
    lambda s, d: queue.seed(job_rows(s, d), table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("new"), F.col("p_partkey").cast("string")).alias("image"), F.lit(None).cast("string").alias("name"), F.lit(1.0).alias("weight"))
    .unionByName(J(s, d).select(F.col("id").alias("seq"), "image", F.col("image").alias("name"), "weight")), 5.0).select("image", "status")
)
query("queue_fail_retry", "SELECT id, CASE WHEN id % 5 = 0 THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status FROM {jobs}")(
    lambda s, d: queue.fail(job_rows(s, d), F.col("id") % 5 == 0, "boom", 9.0).select("id", "status")
)
query("queue_page", "SELECT id, weight FROM {jobs} WHERE status = 'done' AND contains(lower(image), 'g1') ORDER BY weight DESC, id LIMIT 20 OFFSET 40")(lambda s, d: search.page(J(s, d).where(search.equal_filters(status="done", worker=None) & search.containing("image", "G1")), [F.col("weight").desc(), F.col("id")], 3, 20).select("id", "weight"))
query("built_progress", "SELECT count(*) AS total, count(*) FILTER (status = 'done') AS built, round(count(*) FILTER (status = 'done') * 100.0E0 / count(*), 6) AS pct FROM {jobs}")(lambda s, d: J(s, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("built")).withColumn("pct", F.round(tx.percent(F.col("built"), F.col("total")), 6)))

query("events_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(lambda s, d: ev.tumbling(table(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total")))
query("events_sliding", "SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS w FROM events) GROUP BY 1")(lambda s, d: ev.sliding(table(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n"))
query(
    "events_sessions",
    """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k""",
)(lambda s, d: ev.sessions(table(s, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"))
query("events_rate", """WITH h AS (SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS k FROM events) SELECT event_type, round(greatest(0, (arg_max(event_id, ts) - arg_min(event_id, ts)) * 60.0E0 / (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))), 6) AS per_minute FROM h WHERE k <= 8 GROUP BY event_type""")(
    lambda s, d: ev.rate(ev.instants(table(s, d, "events")), "event_type", "ts", "event_id", least_seconds=None).withColumn("per_minute", F.round(F.col("per_minute") * 1e6) / 1e6)  # rounds halves as DuckDB does
)
query("events_properties", "SELECT CAST(props->>'$.k' AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")(lambda s, d: table(s, d, "events").groupBy(F.from_json("props", "k int")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n")))
query("events_first_seen", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")(lambda s, d: counts(ev.first_seen(table(s, d, "events"), ["user_id", "event_type"]), "user_id", "event_type"))

query("normalised_packages", "SELECT p_partkey, lower(list_extract(string_split(split_part(q, '@', 1), '/'), -1)) AS name FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '@scope/' || p_name WHEN 1 THEN 'github.com/x/' || p_name || '@1.1' ELSE p_name END AS q FROM part)")(
    lambda s, d: table(s, d, "part").select("p_partkey", tx.package_name(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("@scope/"), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("github.com/x/"), "p_name", F.lit("@1.1"))).otherwise(F.col("p_name"))).alias("name"))
)
query("reference_keys", "SELECT image, regexp_replace(trim(split_part(r, '@', 1)), '^library/', '') AS key FROM (SELECT image, CASE WHEN image % 2 = 0 THEN 'library/' ELSE ns || '/' END || repo || ':' || tag || '@sha256:' || digest AS r FROM {images})")(
    lambda s, d: I(s, d).select("image", tx.reference_key(F.concat(F.when(F.col("image") % 2 == 0, F.lit("library/")).otherwise(F.concat("ns", F.lit("/"))), "repo", F.lit(":"), "tag", F.lit("@sha256:"), "digest")).alias("key"))
)
query("slugs", "SELECT c_custkey, regexp_replace(regexp_replace(c_name || ' / ' || c_mktsegment || '!', '[^a-zA-Z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", tx.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("!"))).alias("slug")))
query("url_endpoints", "SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1) AS endpoint FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", tx.endpoint(F.col("url")).alias("endpoint")))
query("page_titles", "SELECT page_id, trim(replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '&amp;', '&')) AS title, length(html) AS chars FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", tx.without_tags(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"), F.length("html").cast("bigint").alias("chars")))
query("severity_from_cvss", "SELECT CASE WHEN c >= 9 THEN 'critical' WHEN c >= 7 THEN 'high' WHEN c >= 4 THEN 'medium' WHEN c > 0 THEN 'low' ELSE 'info' END AS severity, count(*) AS n FROM (SELECT (l_quantity - 1) / 5 AS c FROM lineitem) GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy(sev.from_cvss((F.col("l_quantity") - 1) / 5).alias("severity")).agg(F.count(F.lit(1)).alias("n")))
query("severity_synonyms", "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'unknown' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'unknown' END AS severity, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: table(s, d, "orders").groupBy(sev.parse_severity(F.regexp_replace("o_orderpriority", r"^\d-", "")).alias("severity")).agg(F.count(F.lit(1)).alias("n")))
_AV, _AC = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, {"L": 0.77, "H": 0.44}
_IMP = {"H": 0.56, "L": 0.22, "N": 0.0}
_case = lambda c, t: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}E0" for k, v in t.items()) + " END"
_V = "SELECT p_partkey, substr('NALP', 1 + CAST(p_partkey % 4 AS INTEGER), 1) AS av, substr('LH', 1 + CAST(p_size % 2 AS INTEGER), 1) AS ac, substr('NLH', 1 + CAST(p_partkey % 3 AS INTEGER), 1) AS pr, substr('NR', 1 + CAST(p_size % 2 AS INTEGER), 1) AS ui, substr('UC', 1 + CAST(p_partkey % 2 AS INTEGER), 1) AS s, substr('HLN', 1 + CAST(p_size % 3 AS INTEGER), 1) AS c, substr('HLN', 1 + CAST(p_partkey % 3 AS INTEGER), 1) AS i, substr('NLH', 1 + CAST((p_size + p_partkey) % 3 AS INTEGER), 1) AS a FROM part"
query(
    "cvss3_scores",
    f"""WITH v AS ({_V}), n AS (SELECT p_partkey, s = 'C' AS ch, 1.0E0 - ((1.0E0 - {_case("c", _IMP)}) * (1.0E0 - {_case("i", _IMP)})) * (1.0E0 - {_case("a", _IMP)}) AS b, 8.22E0 * {_case("av", _AV)} * {_case("ac", _AC)} * CASE WHEN s = 'C' THEN {_case("pr", {"N": 0.85, "L": 0.68, "H": 0.50})} ELSE {_case("pr", {"N": 0.85, "L": 0.62, "H": 0.27})} END * {_case("ui", {"N": 0.85, "R": 0.62})} AS e FROM v),
 m AS (SELECT p_partkey, ch, e, CASE WHEN ch THEN 7.52E0 * (b - 0.029E0) - 3.25E0 * power(b - 0.02E0, 15.0E0) ELSE 6.42E0 * b END AS x FROM n)
 SELECT p_partkey, CASE WHEN x <= 0 THEN 0.0E0 ELSE CAST(ceil(least(CASE WHEN ch THEN 1.08E0 * (x + e) ELSE x + e END, 10.0E0) * 10.0E0) AS DOUBLE) / 10.0E0 END AS score FROM m""",
)(
    lambda s, d: table(s, d, "part").select("p_partkey", sev.cvss3(F.concat(F.lit("CVSS:3.1"), *(x for k, chars, col in (("AV", "NALP", F.col("p_partkey") % 4), ("AC", "LH", F.col("p_size") % 2), ("PR", "NLH", F.col("p_partkey") % 3), ("UI", "NR", F.col("p_size") % 2), ("S", "UC", F.col("p_partkey") % 2), ("C", "HLN", F.col("p_size") % 3), ("I", "HLN", F.col("p_partkey") % 3), ("A", "NLH", (F.col("p_size") + F.col("p_partkey")) % 3))
    for x in (F.lit(f"/{k}:"), F.substr(F.lit(chars), (col + 1).cast("int"), F.lit(1)))))).alias("score"))
)
query("cves_in_text", "SELECT id, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all('see ' || upper(id) || ' and cve-2020-1234', '(?i)CVE-\\d{4}-\\d{4,7}'))) AS id FROM {findings}) GROUP BY id".replace("SELECT id, count(*)", "SELECT upper(id) AS id, count(*)", 1).replace("GROUP BY id", "GROUP BY 1"))(
    lambda s, d: FI(s, d).select(F.explode(tx.cves_in(F.concat(F.lit("see "), F.upper("id"), F.lit(" and cve-2020-1234")))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
)
RULES = [("hex-token", r'token = "[0-9a-f]{40}"', "high"), ("mail", r"[a-z0-9.]+@mail[0-9]+\.example\.com", "low"), ("license", "General Public License", "info")]
query("text_rules", " UNION ALL ".join(f"SELECT '{n}' AS rule, '{sv}' AS severity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS m FROM documents) HAVING count(*) > 0" for n, p, sv in RULES))(
    lambda s, d: rules.matches(table(s, d, "documents"), RULES, "doc_id", "text").groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))
)
query("full_text_search", "SELECT p_partkey, CAST(12 * list_contains(w, 'red') + 12 * list_contains(w, 'widget') + 6 * (lower(p_brand) = 'red') + 6 * (lower(p_brand) = 'widget') AS INTEGER) AS score FROM (SELECT *, string_split(lower(p_name), ' ') AS w FROM part) WHERE list_contains(w, 'red') OR list_contains(w, 'widget')".replace("list_contains(w, 'red') +", "CAST(list_contains(w, 'red') AS INTEGER) +").replace("12 * list_contains(w, 'widget')", "12 * CAST(list_contains(w, 'widget') AS INTEGER)").replace("6 * (lower(p_brand) = 'red')", "0").replace("6 * (lower(p_brand) = 'widget')", "0"))(
    lambda s, d: search.search(table(s, d, "part"), "Red, WIDGET!", {"p_name": 12, "p_brand": 6}).select("p_partkey", F.col("score").cast("int").alias("score"))
)
_INSTR = "CASE p_partkey % 4 WHEN 0 THEN 'RUN pip install -U ' || replace(p_name, ' ', '==') || ' numpy && ls' WHEN 1 THEN 'RUN npm install -g ' || split_part(p_name, ' ', 1) WHEN 2 THEN 'RUN wget -q https://x.io/' || split_part(p_name, ' ', 2) || ' && ls' ELSE 'ADD https://y.io/' || split_part(p_name, ' ', 1) || ' /opt' END"
query(
    "installed_content",
    """SELECT p_partkey, 'pip' AS kind, split_part(p_name, ' ', 1) AS name, '==' || split_part(p_name, ' ', 2) AS version FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'pip', 'numpy', '' FROM part WHERE p_partkey % 4 = 0
 UNION ALL SELECT p_partkey, 'npm', split_part(p_name, ' ', 1), '' FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT p_partkey, 'wget', 'https://x.io/' || split_part(p_name, ' ', 2), '' FROM part WHERE p_partkey % 4 = 2 UNION ALL SELECT p_partkey, 'add', 'https://y.io/' || split_part(p_name, ' ', 1), '' FROM part WHERE p_partkey % 4 = 3""",
)(
    lambda s, d: rules.installed_content(
        table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("RUN pip install -U "), F.replace("p_name", F.lit(" "), F.lit("==")), F.lit(" numpy && ls"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("RUN npm install -g "), F.split_part("p_name", F.lit(" "), F.lit(1))))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("RUN wget -q https://x.io/"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" && ls"))).otherwise(F.concat(F.lit("ADD https://y.io/"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" /opt"))).alias("i")), "p_partkey", "i")
)
query("topmost_layer_rows", "SELECT l_orderkey AS image, l_partkey % 5 AS path, l_linenumber AS layer, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_partkey % 5 ORDER BY l_linenumber DESC) AS k FROM lineitem) WHERE k = 1 GROUP BY ALL")(
    lambda s, d: counts(rules.topmost(table(s, d, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 5).alias("path"), F.col("l_linenumber").alias("layer"))), "image", "path", "layer")
)
query("platform_match", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type = 'PROMO' AND p_size % 2 = 0 THEN 2 WHEN p_type = 'PROMO' THEN 1 ELSE 0 END DESC, p_partkey) AS k FROM part) WHERE k = 1")(
    lambda s, d: rules.best_platform(table(s, d, "part").select("p_brand", F.col("p_partkey").alias("digest"), F.col("p_type").alias("architecture"), F.when(F.col("p_size") % 2 == 0, "linux").otherwise("windows").alias("os"), F.lit("v8").alias("variant")), "p_brand", "PROMO", "linux").select("p_brand", F.col("digest").alias("p_partkey"))
)
query("verification", """WITH a AS (SELECT scanner AS name, CAST(count(*) AS DOUBLE) AS got FROM {findings} GROUP BY 1), e AS (SELECT name, got * CASE name WHEN 'osv' THEN 1.05E0 WHEN 'grype' THEN 1.005E0 ELSE 1.0E0 END AS want FROM a)
 SELECT name, CASE WHEN got = want THEN 'PASS' WHEN abs(got - want) <= 0.01E0 * abs(want) THEN 'DRIFT' ELSE 'FAIL' END AS status FROM a JOIN e USING (name)""")(
    lambda s, d: (lambda a: a.join(a.select("name", (F.col("got") * F.when(F.col("name") == "osv", 1.05).when(F.col("name") == "grype", 1.005).otherwise(1.0)).alias("want")), "name").select("name", F.when(F.col("got") == F.col("want"), "PASS").when(F.abs(F.col("got") - F.col("want")) <= 0.01 * F.abs("want"), "DRIFT").otherwise("FAIL").alias("status")))(
        kept(FI(s, d).groupBy(F.col("scanner").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("got")))
    )
)
