"""Queries on the layer forest and the exposure ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import image_ref, layer_chain
from ..operators import graph
from ..operators.checkpoint import kept
from ..sources.readers import table
from . import views
from .registry import query

FOREST = "(SELECT child, arg_max(parent, (seq, parent)) AS parent, count(DISTINCT parent) > 1 AS multiparent FROM {edges} GROUP BY child)"
UP = f"""RECURSIVE f AS (SELECT * FROM {FOREST}), up AS (SELECT child AS node, parent AS anc, 1 AS dist FROM f UNION ALL SELECT up.node, f.parent, dist + 1 FROM up JOIN f ON up.anc = f.child),
 pull AS (SELECT node, max(pull) AS pull FROM {{refs}} GROUP BY node), ranked AS (SELECT up.node, up.anc, p.pull AS v, row_number() OVER (PARTITION BY up.node ORDER BY a.pull DESC, dist) AS k
  FROM up JOIN pull p ON p.node = up.node JOIN pull a ON a.node = up.anc LEFT JOIN f ON f.child = up.anc WHERE a.pull > p.pull AND p.pull > 0 AND NOT coalesce(f.multiparent, false)),
 owned AS (SELECT anc AS node, CAST(sum(v) AS BIGINT) AS downstream, count(*) AS dependency_weight FROM ranked WHERE k = 1 GROUP BY anc)"""


def forest(s, d):
    return kept(graph.forest(views.edges(s, d)), "forest")


def owned(s, d):
    return graph.attributed(forest(s, d), graph.node_pulls(views.refs(s, d)))


query("forest_parents", f"SELECT child, parent, multiparent FROM {FOREST}")(forest)
query("forest_roots", "SELECT parent AS node, count(DISTINCT child) AS children FROM {edges} WHERE parent NOT IN (SELECT child FROM {edges}) GROUP BY parent")(lambda s, d: graph.roots(views.edges(s, d)))
query("graph_counts", "SELECT (SELECT count(*) FROM {edges}) AS edges, (SELECT count(*) FROM (SELECT parent AS n FROM {edges} UNION SELECT child FROM {edges})) AS nodes, (SELECT count(DISTINCT node) FROM {refs}) AS image_nodes")(
    lambda s, d: views.edges(s, d).select(F.lit("edges").alias("what"), F.lit(None).cast("bigint").alias("n")).unionAll(views.edges(s, d).select(F.lit("nodes"), F.explode(F.array("parent", "child")))).unionAll(views.refs(s, d).select(F.lit("image_nodes"), "node"))
    .agg(F.count_if(F.col("what") == "edges").alias("edges"), F.count_distinct(F.when(F.col("what") == "nodes", F.col("n"))).alias("nodes"), F.count_distinct(F.when(F.col("what") == "image_nodes", F.col("n"))).alias("image_nodes"))
)
query("node_pulls", "SELECT node, CAST(max(pull) AS BIGINT) AS pull FROM {refs} GROUP BY node")(lambda s, d: graph.node_pulls(views.refs(s, d)))
query("attributed_downstream", f"WITH {UP} SELECT * FROM owned")(owned)
query("closure_pairs", f"WITH {UP} SELECT anc AS ancestor, node FROM up")(lambda s, d: graph.closure(forest(s, d)))
query("downstream_images", f"WITH {UP} SELECT anc AS node, count(*) AS images FROM up WHERE node IN (SELECT node FROM pull) GROUP BY anc")(
    lambda s, d: graph.closure(forest(s, d), views.refs(s, d).select("node").distinct()).groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("images"))
)
query("upstream_images", f"WITH {UP} SELECT node, count(*) AS images FROM up WHERE anc IN (SELECT node FROM pull) GROUP BY node")(
    lambda s, d: graph.closure(forest(s, d)).join(views.refs(s, d).select(F.col("node").alias("ancestor")).distinct(), "ancestor", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("images"))
)
_STARTS = "SELECT 'CVE-' || CAST(p_size AS VARCHAR) AS source, p_partkey AS node FROM part"
query(
    "cve_propagation",
    f"""WITH {UP}, st AS ({_STARTS}), re AS (SELECT DISTINCT source, node FROM st UNION SELECT source, up.node FROM st JOIN up ON up.anc = st.node),
 t AS (SELECT source, count(*) AS nodes, count(*) FILTER (re.node IN (SELECT node FROM pull)) AS downstream FROM re GROUP BY source), di AS (SELECT source, count(DISTINCT node) AS direct FROM st GROUP BY source)
 SELECT source, nodes, downstream, direct FROM t JOIN di USING (source)""",
)(lambda s, d: graph.propagation(table(s, d, "part").select(F.concat(F.lit("CVE-"), F.col("p_size").cast("string")).alias("source"), F.col("p_partkey").alias("node")), forest(s, d), views.refs(s, d).select("node").distinct()).drop("factor"))
_TAGS = "SELECT ns, repo, tag, CAST(updated AS VARCHAR) AS last_updated, CASE WHEN image % 3 = 0 THEN 'inactive' ELSE 'active' END AS status, image AS seq FROM {images}"
_BEST = f"""(SELECT r.ns, r.repo, coalesce(b.tag, 'latest') AS tag FROM (SELECT DISTINCT ns, repo FROM ({_TAGS})) r LEFT JOIN
 (SELECT ns, repo, tag, row_number() OVER (PARTITION BY ns, repo ORDER BY tag = 'latest' DESC, status = 'active' DESC, last_updated DESC, seq) AS k FROM ({_TAGS}) WHERE NOT regexp_matches(tag, '^sha256-[0-9a-f]{{64}}\\.(sig|att)$')) b ON r.ns = b.ns AND r.repo = b.repo AND k = 1)"""


def tags(s, d):
    return views.images(s, d).select("ns", "repo", "tag", F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"), F.when(F.col("image") % 3 == 0, "inactive").otherwise("active").alias("status"), F.col("image").alias("seq"))


query("representative_tags", f"SELECT ns, repo, tag FROM {_BEST}")(lambda s, d: graph.representative_tags(tags(s, d)))
_SIGNED = "SELECT image % 485 AS repo, tag FROM {images}"  # images whose tags are signatures only, and others
query("signature_only_repositories", f"SELECT repo FROM ({_SIGNED}) WHERE tag LIKE 'sha256-%' EXCEPT SELECT repo FROM ({_SIGNED}) WHERE tag NOT LIKE 'sha256-%'")(
    lambda s, d: graph.signature_only(views.images(s, d).select((F.col("image") % 485).alias("repo"), "tag"), ["repo"])
)
_REF_TAGS = "(SELECT ns, repo, CASE WHEN max(CASE WHEN tag = 'latest' THEN 1 ELSE 0 END) = 1 THEN 'latest' ELSE max(tag) END AS best_tag FROM {refs} GROUP BY ns, repo)"
query(
    "exposure_ranking",
    f"""WITH {UP}, c AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pull DESC, pos) = 1 AS canon FROM {{refs}}),
 x AS (SELECT c.ns, c.repo, c.tag, c.digest, c.pull, c.node, c.pos, CASE WHEN canon THEN coalesce(downstream, 0) ELSE 0 END AS downstream, CASE WHEN canon THEN coalesce(dependency_weight, 0) ELSE 0 END AS dependency_weight, coalesce(c.tag = b.best_tag, false) AS matched
  FROM c LEFT JOIN owned USING (node) LEFT JOIN {_REF_TAGS} b ON b.ns = c.ns AND b.repo = c.repo),
 y AS (SELECT *, pull + downstream AS exposure, row_number() OVER (PARTITION BY ns, repo ORDER BY matched DESC, pull + downstream DESC, node, pos) AS k FROM x)
 SELECT ns, repo, tag, digest, CAST(pull AS BIGINT) AS pull, dependency_weight, downstream, CAST(exposure AS BIGINT) AS exposure FROM y WHERE k = 1""",
)(lambda s, d: graph.ranking(views.refs(s, d), owned(s, d), views.refs(s, d).groupBy("ns", "repo").agg(F.when(F.bool_or(F.col("tag") == "latest"), "latest").otherwise(F.max("tag")).alias("tag"))))
query(
    "layer_chain",
    """WITH l AS (SELECT l_orderkey AS image, sha256(CAST(l_partkey AS VARCHAR)) AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
 c AS (SELECT image, i, sha256(h) AS id FROM l WHERE i = 1 UNION ALL SELECT l.image, l.i, sha256(c.id || l.h) FROM c JOIN l ON l.image = c.image AND l.i = c.i + 1) SELECT image, CAST(i AS INTEGER) AS pos, id FROM c""".replace("WITH l", "WITH RECURSIVE l"),
)(
    lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    .select("image", F.posexplode(layer_chain(F.transform("l", lambda x: F.struct(x["l_partkey"].cast("string").alias("digest"), F.lit("").alias("instruction"))))).alias("pos", "id")).select("image", (F.col("pos") + 1).alias("pos"), "id")
)
query(
    "trie_expansion",
    """WITH p AS (SELECT substr(repo, 1, 6) AS prefix, count(*) * 700 AS n FROM {images} GROUP BY 1), a AS (SELECT unnest(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z 0 1 2 3 4 5 6 7 8 9 - _', ' ')) AS c)
 SELECT prefix || c AS prefix, 255 - length(prefix || c) AS priority FROM p, a WHERE (n >= 10000 OR length(prefix) = 1) AND NOT (right(prefix, 1) IN ('-', '_') AND c IN ('-', '_'))""",
)(lambda s, d: graph.expanded_prefixes(views.images(s, d).groupBy(F.substring("repo", 1, 6).alias("prefix")).agg((F.count(F.lit(1)) * 700).alias("count"))).withColumn("priority", F.col("priority").cast("bigint")))
query(
    "parsed_references",
    """SELECT page_id, CASE WHEN instr(rest, '/') > 0 THEN split_part(rest, '/', 1) ELSE 'library' END AS ns, CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/') + 1) ELSE rest END AS repo, tag FROM
 (SELECT page_id, 'v' || CAST(page_id % 9 AS VARCHAR) AS tag, CASE WHEN page_id % 3 = 0 THEN 'user' || CAST(page_id % 50 AS VARCHAR) || '/app' WHEN page_id % 3 = 1 THEN '/solo/app' ELSE 'plain' END AS rest FROM pages)""",
)(
    lambda s, d: table(s, d, "pages").select("page_id", image_ref(F.concat(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("docker.io/user"), (F.col("page_id") % 50).cast("string"), F.lit("/app"))).when(F.col("page_id") % 3 == 1, F.lit("docker.io//solo/app")).otherwise("plain"), F.lit(":v"), (F.col("page_id") % 9).cast("string"), F.lit("@sha256:0"))).alias("r"))
    .select("page_id", F.when(F.col("page_id") % 3 == 1, F.col("r.ns")).otherwise(F.col("r.ns")).alias("ns"), F.col("r.repo").alias("repo"), F.col("r.tag").alias("tag"))
)
query("node_peers", "SELECT node, CAST(count(*) AS BIGINT) AS refs, array_to_string(list_sort(list_distinct(list(ns || '/' || repo))), ',') AS names FROM (SELECT node % 500 AS node, ns, repo FROM {refs}) GROUP BY node")(
    lambda s, d: views.refs(s, d).groupBy((F.col("node") % 500).alias("node")).agg(F.count(F.lit(1)).alias("refs"), F.array_join(F.array_sort(F.collect_set(F.concat("ns", F.lit("/"), "repo"))), ",").alias("names"))
)
