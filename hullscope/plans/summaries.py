"""Queries on corpus summaries, verification, image metadata and the graph's raw layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as ops
from ..operators import catalogue, graph, images, rules, summary
from ..sources import readers
from ..sources.readers import table
from . import views
from .catalogues import RULES
from .corpus import OK, runs
from .files import staged
from .graphs import UP, forest
from .prevalence import MERGED, merged
from .registry import query

TARGETS = "(SELECT o_orderkey AS target, CASE WHEN o_orderkey % 23 = 0 THEN 'no manifest' ELSE '' END AS skipped_reason, CASE WHEN o_orderkey % 3 = 0 THEN '10.0.0.1' END AS ip, CAST(epoch(o_orderdate) AS BIGINT) AS started_at, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 400 - 20 AS finished_at FROM orders)"


def targets(s, d):
    k = F.col("o_orderkey")
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return table(s, d, "orders").select(k.alias("target"), F.when(k % 23 == 0, "no manifest").otherwise("").alias("skipped_reason"), F.when(k % 3 == 0, "10.0.0.1").alias("ip"), at.alias("started_at"), (at + k % 400 - 20).alias("finished_at"))


_ROW = "SELECT '{s}' AS section, CAST({k} AS VARCHAR) AS key, CAST({v} AS DOUBLE) AS value FROM {f}"
_RUNS = f"(SELECT scanner, count(*) AS runs, count(*) FILTER (WHERE {OK}) AS ok, round(avg(wall_seconds), 1) AS avg_seconds, round(max(peak_mem_mb), 1) AS peak_mem_mb FROM {{runs}} GROUP BY scanner)"
query(
    "corpus_summary",
    f"WITH m AS (SELECT * FROM {MERGED}) "
    + " UNION ALL ".join(
        [_ROW.format(s=x, k=x, v="count(*)", f=f"m GROUP BY {x}") for x in ("severity", "category")]
        + [_ROW.format(s="scanner", k="x", v="count(*)", f="(SELECT unnest(found_by) AS x FROM m) GROUP BY x"), _ROW.format(s="agreement", k="least(len(found_by), 4)", v="count(*)", f="m WHERE category = 'pkg-vuln' GROUP BY least(len(found_by), 4)")]
        + [_ROW.format(s=x, k="scanner", v=x, f=_RUNS) for x in ("runs", "ok", "avg_seconds", "peak_mem_mb")]
        + [_ROW.format(s="targets", k=f"'{k}'", v=f"count(*) FILTER ({c})", f=TARGETS) for k, c in (("targets", "true"), ("scanned", "skipped_reason = ''"), ("with_ip", "ip IS NOT NULL"))]
        + [_ROW.format(s="targets", k="'merged'", v="count(*)", f="m")]
    ),
)(lambda s, d: summary.corpus_summary(targets(s, d), runs(s, d), merged(s, d)))
query("throughput_figures", f"""WITH t AS (SELECT *, CASE WHEN finished_at >= started_at THEN finished_at - started_at END AS seconds FROM {TARGETS}), a AS (SELECT CAST(max(finished_at) - min(started_at) AS DOUBLE) AS span, count(*) FILTER (skipped_reason = '') AS scanned, avg(seconds) AS mean FROM t),
 m AS (SELECT seconds FROM (SELECT seconds, row_number() OVER (ORDER BY seconds) - 1 AS i, count(*) OVER () AS n FROM t WHERE seconds IS NOT NULL) WHERE i = n // 2), c AS (SELECT CAST(sum(wall_seconds) AS DOUBLE) AS cpu FROM {{runs}})
 SELECT round(span, 1) AS span, round(scanned / span * 60, 3) AS per_minute, round(scanned / span * 3600, 1) AS per_hour, round(mean, 1) AS avg_seconds, CAST((SELECT seconds FROM m) AS DOUBLE) AS median_seconds, round((SELECT cpu FROM c), 1) AS cpu_seconds, round((SELECT cpu FROM c) / span, 2) AS parallelism FROM a""")(lambda s, d: summary.throughput(targets(s, d), runs(s, d)))
query("merged_cves", f"SELECT count(DISTINCT upper(lid)) AS cves FROM {MERGED} WHERE lid LIKE 'cve%'")(lambda s, d: summary.distinct_cves(merged(s, d)))
query("merged_by_target", f"SELECT target_name, count(*) AS findings, " + ", ".join(f"count(*) FILTER (severity = '{x}') AS {x}" for x in ops.SEVERITIES) + f" FROM {MERGED} GROUP BY 1")(lambda s, d: summary.by_target(merged(s, d), ops.SEVERITIES))


def named_runs(s, d):
    """Runs under the names of the scanners that the findings have."""
    return runs(s, d).withColumn("scanner", F.element_at(F.array(*map(F.lit, ops.SCANNERS)), (F.col("target") % 3 + 1).cast("int")))


query("scanner_report", f"""WITH m AS (SELECT unnest(found_by) AS scanner, len(found_by) AS k, severity, category FROM {MERGED}), r AS (SELECT *, CASE target % 3 WHEN 0 THEN 'trivy' WHEN 1 THEN 'grype' ELSE 'osv' END AS name FROM {{runs}}),
 x AS (SELECT name, wall_seconds, row_number() OVER (PARTITION BY name ORDER BY wall_seconds) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM r), p AS (SELECT name, max(CASE WHEN i = CAST(round_even((n - 1) * 0.95E0, 0) AS BIGINT) THEN wall_seconds END) AS p95 FROM x GROUP BY name),
 a AS (SELECT name, count(*) AS runs, count(*) FILTER (WHERE {OK}) AS ok, count(*) FILTER (status LIKE 'error%') AS errors, count(*) FILTER (status LIKE 'timeout%') AS timeouts, count(*) FILTER (status LIKE 'skip%') AS skips, max(peak_mem_mb) AS peak_mem_mb FROM r GROUP BY name),
 f AS (SELECT scanner, count(*) AS merged, count(*) FILTER (k = 1 AND severity NOT IN ('info', 'unknown')) AS exclusive_meaningful, count(*) FILTER (k = 1) AS exclusive FROM m GROUP BY scanner), o AS (SELECT DISTINCT min(scanner) AS scanner FROM m GROUP BY category HAVING min(scanner) = max(scanner))
 SELECT a.name AS scanner, runs, ok, errors, timeouts, skips, peak_mem_mb, p95, coalesce(merged, 0) AS merged, coalesce(exclusive_meaningful, 0) AS exclusive_meaningful, coalesce(exclusive, 0) AS exclusive, o.scanner IS NOT NULL AS sole FROM a JOIN p USING (name) LEFT JOIN f ON f.scanner = a.name LEFT JOIN o ON o.scanner = a.name""")(lambda s, d: summary.scanner_table(named_runs(s, d), merged(s, d)))


def values(s, d):
    """Two tables of the same names: what parts say of each brand, and what lineitem does, printed in different forms."""
    p = table(s, d, "part")
    want = p.groupBy("p_brand").agg(F.sum("p_size").alias("n")).select(F.concat(F.lit("sum "), "p_brand").alias("name"), F.format_number("n", 0).alias("value"), F.lit(None).cast("double").alias("tol"), F.lit(False).alias("known"))
    big = p.groupBy("p_brand").agg(F.sum("p_size").alias("n")).select(F.concat(F.lit("drift "), "p_brand").alias("name"), F.concat(F.lit("+"), F.col("n").cast("string"), F.lit("\\%")).alias("value"), F.when(F.col("n") % 2 == 0, 0.2).alias("tol"), (F.col("n") % 3 == 0).alias("known"))
    alone = p.select(F.concat(F.lit("alone "), "p_brand").alias("name"), F.lit("x").alias("value"), F.lit(None).cast("double").alias("tol"), F.lit(True).alias("known")).distinct()
    got = p.groupBy("p_brand").agg(F.sum("p_size").alias("n"))
    got = got.select(F.concat(F.lit("sum "), "p_brand").alias("name"), F.col("n").cast("string").alias("value")).unionByName(got.select(F.concat(F.lit("drift "), "p_brand").alias("name"), (F.col("n") * 1.1).cast("string").alias("value")))
    return want.unionByName(big).unionByName(alone), got


query("verified_values", """WITH b AS (SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS n FROM part GROUP BY 1) SELECT 'sum ' || p_brand AS name, 'PASS' AS status FROM b UNION ALL SELECT 'alone ' || p_brand, 'SKIP' FROM b
 UNION ALL SELECT 'drift ' || p_brand, CASE WHEN n % 2 = 0 THEN 'DRIFT' WHEN n % 3 = 0 THEN 'KNOWN' ELSE 'FAIL' END FROM b""")(lambda s, d: summary.verified(*values(s, d)))

_START = "CASE CAST(p_partkey % 5 AS INTEGER) WHEN 0 THEN '/usr/bin/app' || p_size WHEN 1 THEN '/srv/run' || p_size || '.py' WHEN 2 THEN '/start' || p_size || '.sh' WHEN 3 THEN NULL ELSE '/srv/node' || p_size END"


@query("start_files", f"SELECT p_partkey, {_START} AS file FROM part")
def start_files(s, d):
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    words = lambda *x: F.array(*(F.lit(w) if isinstance(w, str) else w for w in x))
    none = F.array().cast("array<string>")
    entry = F.when(k == 0, words(F.concat(F.lit("/usr/bin/app"), n))).when(k == 4, words(F.concat(F.lit("./node"), n))).otherwise(none)
    cmd = F.when(k == 0, words("--flag")).when(k == 1, words("python", F.concat(F.lit("run"), n, F.lit(".py")))).when(k == 2, words("/bin/sh", "-c", F.concat(F.lit("start"), n, F.lit(".sh && x")))).otherwise(none)
    return table(s, d, "part").select("p_partkey", images.start_file(entry, cmd, F.when(k.isin(1, 4), F.lit("/srv/"))).alias("file"))


@query("job_images", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'library' ELSE 'u' || o_custkey END AS ns, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'r' || o_custkey END AS repo, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 2 THEN 'v' || o_custkey ELSE 'latest' END AS tag, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'sha256:' || o_orderkey END AS digest FROM orders")
def job_images(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    left = F.when(k % 4 == 1, F.concat(F.lit("r"), c)).when(k % 4 == 2, F.concat(F.lit("/u"), c, F.lit("/r"), c, F.lit(":v"), c)).otherwise(F.concat(F.lit("u"), c, F.lit("/r"), c))
    raw = F.when(k % 4 == 0, left).otherwise(F.concat(left, F.lit("@sha256:"), k.cast("string")))
    return table(s, d, "orders").select(k.alias("k"), images.job_image(raw).alias("j")).select("k", "j.ns", "j.repo", "j.tag", "j.digest")


_ISSUES = "(SELECT l_orderkey AS image, CAST(l_linenumber AS BIGINT) AS layer, l_partkey % 3 AS path, CASE l_suppkey % 4 WHEN 0 THEN 'secret' WHEN 1 THEN 'component' WHEN 2 THEN 'vulnerability' ELSE 'malware' END AS kind, l_partkey AS id, l_quantity > 45 AS clean FROM lineitem)"


@query("merged_layers", f"""WITH i AS (SELECT * FROM {_ISSUES}), f AS (SELECT image, path, arg_max(clean, (layer, id)) AS mended FROM i GROUP BY image, path), o AS (SELECT i.* FROM i JOIN f USING (image, path) WHERE kind <> 'secret' AND (kind = 'component' OR NOT mended)),
 t AS (SELECT image, path, max(layer) AS layer FROM o GROUP BY image, path) SELECT image, layer, path, kind, count(*) AS n FROM (SELECT o.* FROM o JOIN t USING (image, path, layer) UNION ALL SELECT * FROM i WHERE kind = 'secret') GROUP BY ALL""")
def layer_merge(s, d):
    i = table(s, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("bigint").alias("layer"), (F.col("l_partkey") % 3).alias("path"), F.element_at(F.array(*map(F.lit, ("secret", "component", "vulnerability", "malware"))), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("kind"), F.col("l_partkey").alias("id"), (F.col("l_quantity") > 45).alias("clean"))
    last = i.groupBy("image", "path", "layer").agg(F.max_by("clean", "id").alias("clean"))  # a layer's word for a path
    return ops.counts(images.merged_layers(i.drop("clean"), last), "image", "layer", "path", "kind")


@query("reused_results", """WITH r AS (SELECT image AS seq, ns, repo, tag, digest, image % 3 = 0 AS analysed, image % 50 AS issues, 'p' || image AS params FROM {images} WHERE image % 2 = 0), w AS (SELECT * FROM r WHERE analysed),
 own AS (SELECT ns, repo, tag, digest, arg_min(issues, seq) AS issues, arg_min(params, seq) AS params, 1 AS hit FROM w GROUP BY 1, 2, 3, 4), oth AS (SELECT digest, arg_min(issues, seq) AS issues, 1 AS hit FROM w WHERE digest <> '' GROUP BY 1)
 SELECT CASE WHEN own.hit = 1 THEN 'own' WHEN oth.hit = 1 THEN 'digest' ELSE 'new' END AS source, count(*) AS n, CAST(sum(coalesce(own.issues, oth.issues)) AS BIGINT) AS issues, count(DISTINCT coalesce(own.params, 'now')) AS params FROM {images} i LEFT JOIN own ON own.ns = i.ns AND own.repo = i.repo AND own.tag = i.tag AND own.digest = i.digest LEFT JOIN oth ON oth.digest = i.digest GROUP BY 1""")
def reuse(s, d):
    i = views.images(s, d)
    results = i.where("image % 2 = 0").select(F.col("image").alias("seq"), "ns", "repo", "tag", "digest", (F.col("image") % 3 == 0).alias("analysed"), (F.col("image") % 50).alias("issues"), F.concat(F.lit("p"), F.col("image").cast("string")).alias("params"))
    return images.reused_results(i.withColumn("params", F.lit("now")), results).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("issues").alias("issues"), F.count_distinct("params").alias("params"))


def matches(s, d):
    k = F.col("l_partkey")
    path = lambda i: F.concat(F.lit("/p"), ((k + i) % 7).cast("string"))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("seq"), (k % 20).cast("string").alias("name"), F.lit("1").alias("version"), F.array(path(0), path(1)).alias("paths"), F.lit("go").alias("language"), F.lit("lib").alias("type"), F.concat(F.lit("CVE-"), k.cast("string")).alias("id"), F.when(k % 4 == 0, F.array().cast("array<double>")).otherwise(F.array(F.col("l_quantity").cast("double"), F.lit(9.9))).alias("scores"))


query("image_components", "SELECT DISTINCT l_orderkey AS image, CAST(l_partkey % 20 AS VARCHAR) AS name, '1' AS version, '/p' || ((l_partkey + i) % 7) AS path, 'go' AS language, 'lib' AS type FROM lineitem, (VALUES (0), (1)) v(i)")(lambda s, d: images.components_of(matches(s, d)))
query("match_scores", "SELECT l_orderkey AS image, 'CVE-' || l_partkey AS id, '/p' || (l_partkey % 7) AS path, CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_quantity AS DOUBLE) END AS cvss FROM lineitem")(lambda s, d: images.match_scores(matches(s, d)))

_NODES = "(SELECT p_partkey AS node, CASE WHEN p_size % 6 = 0 THEN '' ELSE 'd' || p_partkey % 40 END AS digest, p_size AS size, CASE WHEN p_size % 9 = 0 THEN 'EXPOSE ' || p_size ELSE 'RUN x' END AS instruction, p_partkey AS seq FROM part)"


def nodes(s, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    return table(s, d, "part").select(k.alias("node"), F.when(n % 6 == 0, "").otherwise(F.concat(F.lit("d"), (k % 40).cast("string"))).alias("digest"), n.alias("size"), F.when(n % 9 == 0, F.concat(F.lit("EXPOSE "), n.cast("string"))).otherwise("RUN x").alias("instruction"), k.alias("seq"))


query("raw_layers", f"SELECT digest, arg_min(size, seq) AS size, arg_min(instruction, seq) AS instruction FROM {_NODES} WHERE digest <> '' GROUP BY 1")(lambda s, d: images.raw_layers(nodes(s, d))[0])
query("raw_layer_sources", f"""WITH {UP.replace("up AS (", "up AS (").split(", ranked AS")[0]}, l AS (SELECT DISTINCT node AS start, digest FROM {_NODES} WHERE digest <> ''), e AS (SELECT node FROM pull),
 c AS (SELECT l.digest, l.start, l.start AS node, 0 AS dist FROM l UNION ALL SELECT l.digest, l.start, up.node, up.dist FROM l JOIN up ON up.anc = l.start), h AS (SELECT c.* FROM c WHERE node IN (SELECT node FROM e)),
 b AS (SELECT DISTINCT h.digest, h.node FROM h WHERE NOT EXISTS (SELECT 1 FROM up JOIN e ON e.node = up.anc WHERE up.node = h.node AND up.dist < h.dist) AND (h.dist = 0 OR h.start NOT IN (SELECT node FROM e)))
 SELECT digest, node FROM b""")(lambda s, d: images.source_nodes(images.raw_layers(nodes(s, d))[1], forest(s, d), views.refs(s, d)))
query("exposed_nodes", f"""WITH {UP.split(", ranked AS")[0]}, x AS (SELECT node, instruction FROM {_NODES} WHERE instruction LIKE 'EXPOSE%'), r AS (SELECT node, instruction FROM x UNION SELECT up.node, instruction FROM x JOIN up ON up.anc = x.node)
 SELECT node, array_to_string(list_sort(list(DISTINCT instruction)), ',') AS ports FROM r WHERE node IN (SELECT node FROM pull) GROUP BY node""")(lambda s, d: images.exposed_nodes(nodes(s, d), forest(s, d), views.refs(s, d)).withColumn("ports", F.array_join("ports", ",")))


def propagated(s, d):
    """Identifiers with the digests that they are found in, over the forest."""
    part = table(s, d, "part")
    own = part.select(F.concat(F.lit("CVE-"), F.col("p_size").cast("string")).alias("source"), F.md5(F.col("p_partkey").cast("string")).alias("digest"))
    at = images.digests_to_nodes(views.refs(s, d).select("digest", "node", F.col("node").alias("seq")), own)
    starts = own.join(at, "digest").select("source", "node")
    names = part.groupBy(F.concat(F.lit("CVE-"), F.col("p_size").cast("string")).alias("source")).agg(F.when(F.min("p_size") % 7 == 3, "zlib").otherwise("other").alias("package"))
    return images.top_propagation(graph.propagation(starts, forest(s, d), views.refs(s, d).select("node").distinct()).join(names, "source"))


_REACH = f"""{UP.split(", ranked AS")[0]}, st AS (SELECT 'CVE-' || p_size AS source, p_partkey AS node, CASE WHEN p_size % 7 = 3 THEN 'zlib' ELSE 'other' END AS package FROM part WHERE p_partkey IN (SELECT node FROM pull)), re AS (SELECT source, node FROM st UNION SELECT source, up.node FROM st JOIN up ON up.anc = st.node),
 t AS (SELECT source, count(*) AS nodes, count(*) FILTER (re.node IN (SELECT node FROM pull)) AS downstream FROM re GROUP BY source), di AS (SELECT source, count(DISTINCT node) AS direct, any_value(package) AS package FROM st GROUP BY source),
 top AS (SELECT source, nodes, downstream, direct, round_even(downstream / CAST(direct AS DOUBLE), 1) AS factor, package FROM t JOIN di USING (source) ORDER BY downstream DESC, source LIMIT 10)"""
query("propagation_top", f"WITH {_REACH} SELECT * FROM top")(lambda s, d: propagated(s, d)[0])
query("propagation_range", f"WITH {_REACH} SELECT min(downstream) AS downstream_min, max(downstream) AS downstream_max, min(factor) AS factor_min, max(factor) AS factor_max, max(CASE WHEN package = 'zlib' THEN downstream END) AS of_package FROM top")(lambda s, d: propagated(s, d)[1])


def repositories(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select((k % 40).alias("ns"), k.alias("repo"), (k * 37 % 1000).alias("pull_count"), F.when(k % 3 == 0, 5.0).alias("graph_built_at"), (k % 5 == 0).alias("build_claimed"), F.when(k % 5 == 0, 4.0).alias("build_started_at"))


_REPOS = "(SELECT c_custkey % 40 AS ns, c_custkey AS repo, c_custkey * 37 % 1000 AS pull_count, CASE WHEN c_custkey % 3 = 0 THEN 5.0E0 END AS graph_built_at, c_custkey % 5 = 0 AS build_claimed FROM customer)"
query("build_claims", f"WITH f AS (SELECT ns, repo FROM {_REPOS} WHERE pull_count >= 100 AND graph_built_at IS NULL AND NOT build_claimed ORDER BY pull_count DESC, ns, repo LIMIT 20) SELECT r.ns, r.repo, f.repo IS NOT NULL OR r.build_claimed AS build_claimed, CASE WHEN f.repo IS NOT NULL THEN 9.0E0 WHEN r.build_claimed THEN 4.0E0 END AS build_started_at FROM {_REPOS} r LEFT JOIN f ON f.ns = r.ns AND f.repo = r.repo")(
    lambda s, d: images.build_claim(repositories(s, d), 100, 20, 9.0).select("ns", "repo", "build_claimed", "build_started_at")
)
query("build_resets", f"SELECT ns, repo, CASE WHEN build_claimed AND graph_built_at IS NULL THEN false ELSE build_claimed END AS build_claimed FROM {_REPOS}")(lambda s, d: images.build_reset(repositories(s, d)).select("ns", "repo", "build_claimed"))
query("builds_done", f"SELECT ns, repo, CASE WHEN repo % 4 = 0 THEN 11.0E0 ELSE graph_built_at END AS graph_built_at, CASE WHEN repo % 4 = 0 THEN false ELSE build_claimed END AS build_claimed FROM {_REPOS}")(lambda s, d: images.build_done(repositories(s, d), repositories(s, d).where("repo % 4 = 0"), 11.0).select("ns", "repo", "graph_built_at", "build_claimed"))
query("repeated_keys", "SELECT repo, tag, count(*) AS n FROM {images} GROUP BY ALL HAVING count(*) > 1")(lambda s, d: images.unique_by(views.images(s, d), ["repo", "tag"]))


@query("loaded_rules", " UNION ALL ".join(f"SELECT '{n}' AS rule, '{sv}' AS severity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS m FROM documents) HAVING count(*) > 0" for n, p, sv in RULES))
def loaded_rules(s, d):
    """Rules from a file, applied to all texts."""
    form = ["- name: {n}\n  regex: '{p}'\n  severity: {v}", "# next\n- name: '{n}'\n  severity: {v}\n  regex: '{p}'"]
    doc = "\n".join(form[i % 2].format(n=n, p=p.replace("'", "''"), v=v.upper()) for i, (n, p, v) in enumerate(RULES))
    path = staged(s.createDataFrame([(doc,)], "value string"), "rules")
    own = [(r["name"], r["regex"], r["severity"]) for r in readers.rules(s, path).collect()]  # configuration
    return rules.matches(table(s, d, "documents"), own, "doc_id", "text").groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


def repos(s, d):
    return views.images(s, d).groupBy("ns", "repo").agg(F.max("pull").alias("pull_count"), F.when(F.min("image") % 2 == 0, F.min("updated")).alias("analysed"))


_REPO = "(SELECT ns, repo, max(pull) AS pull_count, CASE WHEN min(image) % 2 = 0 THEN min(updated) END AS analysed FROM {images} GROUP BY ns, repo)"
_JOBS = f"SELECT i.ns, i.repo, i.tag, i.updated, i.image, r.pull_count, r.analysed FROM {{images}} i JOIN {_REPO} r ON i.ns = r.ns AND i.repo = r.repo"
query("jobs_over_threshold", f"SELECT ns, repo, tag FROM ({_JOBS}) WHERE pull_count > 300000")(lambda s, d: catalogue.job_targets(repos(s, d), views.images(s, d).select("ns", "repo", "tag", "updated"), threshold=300000))
query("jobs_of_newest_tags", f"SELECT ns, repo, tag FROM (SELECT *, row_number() OVER (PARTITION BY ns, repo ORDER BY updated DESC, tag) AS k FROM ({_JOBS})) WHERE k <= 2")(lambda s, d: catalogue.job_targets(repos(s, d), views.images(s, d).select("ns", "repo", "tag", "updated"), newest=2))
query("jobs_to_refresh", f"SELECT ns, repo, tag FROM ({_JOBS}) WHERE analysed IS NULL OR updated > analysed")(lambda s, d: catalogue.job_targets(repos(s, d), views.images(s, d).select("ns", "repo", "tag", "updated"), refresh=True))
query("exported_results", "SELECT image FROM {images} i WHERE EXISTS (SELECT 1 FROM {images} w WHERE w.image % 8 = 0 AND w.ns = i.ns AND w.repo = i.repo AND w.tag = i.tag AND (w.digest = '' OR w.digest = i.digest))")(
    lambda s, d: catalogue.exported(views.images(s, d), views.images(s, d).where("image % 8 = 0").select("ns", "repo", "tag", "digest")).select("image")
)
query("undigested_jobs", "SELECT id FROM (SELECT id, CASE WHEN id % 3 = 0 THEN image || '@sha256:0' ELSE image END AS image FROM {jobs}) WHERE image NOT LIKE '%@sha256:%'")(
    lambda s, d: views.jobs(s, d).withColumn("image", F.when(F.col("id") % 3 == 0, F.concat("image", F.lit("@sha256:0"))).otherwise(F.col("image"))).where(~F.col("image").contains("@sha256:")).select("id")
)
query("container_maps", """SELECT image, '{' || string_agg('"' || scanner || '":{"critical":' || c || ',"high":' || h || '}', ',' ORDER BY scanner) || '}' AS doc FROM (SELECT image, scanner, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM {findings} GROUP BY image, scanner) GROUP BY image""")(
    lambda s, d: summary.severity_maps(views.findings(s, d), ("critical", "high"))
)
query("official_severity", "SELECT ns = 'Library' AS official, round(count(*) FILTER (secrets > 0) * 100.0E0 / count(*), 6) AS secret_pct, round(count(*) FILTER (severe > 0) * 100.0E0 / count(*), 6) AS severe_pct FROM (SELECT i.image, any_value(ns) AS ns, count(*) FILTER (category = 'secret') AS secrets, count(*) FILTER (severity IN ('high', 'critical')) AS severe FROM {images} i LEFT JOIN {findings} f ON f.image = i.image GROUP BY i.image) GROUP BY 1")(
    lambda s, d: summary.shares_by(views.images(s, d).select("image", (F.col("ns") == "Library").alias("official")), views.findings(s, d), "official")
)
query("cve_first_seen", "SELECT id, arg_min(severity, seq) AS severity, arg_min(package, seq) AS package, count(DISTINCT digest) AS digests FROM {findings} f JOIN (SELECT image, digest FROM {images} WHERE digest <> '') i ON i.image = f.image WHERE id LIKE 'CVE-%' GROUP BY id")(
    lambda s, d: summary.first_seen(views.findings(s, d).where("startswith(id, 'CVE-')"), views.images(s, d).where("digest <> ''").select("image", "digest"))
)
query("severe_families", "SELECT CASE WHEN e = 'go-module' THEN 'go' WHEN e = 'pypi' THEN 'py' ELSE e END AS family, count(*) AS n FROM (SELECT lower(ecosystem) AS e, severity FROM {findings} WHERE category = 'pkg-vuln') WHERE e IN ('go-module', 'npm', 'pypi') AND severity IN ('high', 'critical') GROUP BY 1")(lambda s, d: summary.language_families(views.findings(s, d)))
query("build_progress", "SELECT total, built, round(built * 100.0E0 / total, 6) AS pct, round(built / hours, 6) AS per_hour, round((total - built) / (built / hours), 6) AS hours_left FROM (SELECT count(*) AS total, count(*) FILTER (status = 'done') AS built, (max(started_at) - min(started_at)) / 3600 AS hours FROM {jobs})")(
    lambda s, d: summary.progress(views.jobs(s, d), F.col("status") == "done", "started_at").select("total", "built", *(F.round(c, 6).alias(c) for c in ("pct", "per_hour", "hours_left")))
)
query("scanner_target_severities", "SELECT scanner, image, count(*) AS n, CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS critical, CAST(count(*) FILTER (severity = 'high') AS BIGINT) AS high FROM {findings} GROUP BY ALL")(lambda s, d: views.findings(s, d).groupBy("scanner", "image").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("severity") == x).alias(x) for x in ("critical", "high"))))
