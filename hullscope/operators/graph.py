"""The layer forest: construction, single-owner attribution of pulls, reachability and closures, and the exposure ranking.

Loops keep a frontier that shrinks every round, joined with the edges by key; each round's frontier is written to the
shared folder, so lineage stays short and a lost executor costs one round. Walks end after one turn of a cycle; more than
``max_depth`` rounds raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import signature_tag
from .checkpoint import kept

MAX_DEPTH = 10_000


def chain(images: DataFrame, ids: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, tops) of layer-id arrays: distinct nodes with the images on top of them, distinct edges, and (image, top node)."""
    rows = images.select("image", ids.alias("ids")).where(F.size("ids") > 0)
    nodes = rows.select("image", F.posexplode("ids").alias("pos", "id"), F.size("ids").alias("n"))
    nodes = nodes.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("pos") == F.col("n") - 1, F.col("image")))).alias("images"))
    edges = rows.select(F.explode(F.arrays_zip(F.slice("ids", F.lit(1), F.size("ids") - 1).alias("parent"), F.slice("ids", F.lit(2), F.size("ids")).alias("child"))).alias("e")).select("e.parent", "e.child").where("child IS NOT NULL").distinct()
    return nodes, edges, rows.select("image", F.element_at("ids", -1).alias("node"))


def forest(edges: DataFrame) -> DataFrame:
    """child, parent (the last one by seq wins, the greater of equals) and whether it had several distinct parents."""
    return edges.groupBy("child").agg(F.max_by("parent", F.struct("seq", "parent")).alias("parent"), (F.count_distinct("parent") > 1).alias("multiparent"))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that are nobody's child, with their number of children."""
    return edges.groupBy(F.col("parent").alias("node")).agg(F.count_distinct("child").alias("children")).join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")


def node_pulls(refs: DataFrame) -> DataFrame:
    """node, pull: the most pulled reference on the node, 0 where none is known."""
    return refs.groupBy("node").agg(F.coalesce(F.max("pull"), F.lit(0)).alias("pull"))


def attributed(parents: DataFrame, pulls: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """node, downstream, dependency_weight: each image node's pull goes to one owner, the most pulled ancestor with a greater
    pull that has one parent line only (nearest of equals); nodes without dependents aren't in the result."""
    p = pulls.select(F.col("node").alias("p_node"), F.col("pull").alias("p_pull"))
    up = parents.select(F.col("child").alias("u_child"), "parent")
    several = parents.select(F.col("child").alias("m_child"), "multiparent")
    # the ancestor's own pull and eligibility, once for each edge
    step = kept(up.join(p, F.col("parent") == F.col("p_node"), "left").join(several, F.col("parent") == F.col("m_child"), "left").select("u_child", "parent", F.coalesce("p_pull", F.lit(0)).alias("a_pull"), F.coalesce("multiparent", F.lit(False)).alias("a_multi")), "steps")
    open_ = pulls.where("pull > 0").select("node", F.col("node").alias("cur"), F.col("pull").alias("best"), F.lit(None).cast(pulls.schema["node"].dataType).alias("owner"), "pull", F.col("node").alias("mark"))
    done = None
    for i in range(max_depth):
        joined = kept(open_.join(step, F.col("cur") == F.col("u_child"), "left"), "frontier")
        over = F.col("u_child").isNull() | (F.col("parent") == F.col("mark"))  # at a root, or once around a cycle
        better = (F.col("a_pull") > F.col("best")) & ~F.col("a_multi")
        ended = joined.where(over & F.col("owner").isNotNull()).select("owner", "pull")
        done = ended if done is None else done.unionByName(ended)
        open_ = joined.where(~over).select("node", F.col("parent").alias("cur"), F.when(better, F.col("a_pull")).otherwise(F.col("best")).alias("best"), F.when(better, F.col("parent")).otherwise(F.col("owner")).alias("owner"), "pull", marked(i, "parent"))
        if open_.isEmpty():
            return done.groupBy(F.col("owner").alias("node")).agg(F.sum("pull").alias("downstream"), F.count(F.lit(1)).alias("dependency_weight"))
    raise RuntimeError(f"chains of over {max_depth} nodes")


def marked(i: int, at: str) -> Column:
    """A walker's mark moves to where it stands at every power of two; it meets the mark again only by going around a cycle."""
    return (F.col(at) if (i + 1) & i == 0 else F.col("mark")).alias("mark")


def reachable(starts: DataFrame, parents: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(source, node): every node below a source's start nodes, the starts included. starts: (source, node)."""
    down = parents.select("parent", "child")
    frontier = kept(starts.select("source", "node").distinct(), "reach")
    seen = frontier
    for _ in range(max_depth):
        new = frontier.join(down, F.col("node") == F.col("parent")).select("source", F.col("child").alias("node")).distinct()
        frontier = kept(new.join(seen, ["source", "node"], "left_anti"), "reach")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"chains of over {max_depth} nodes")


def propagation(starts: DataFrame, parents: DataFrame, image_nodes: DataFrame) -> DataFrame:
    """By source: start nodes, nodes reached, image nodes reached (starts included), and their ratio."""
    reach = reachable(starts, parents).join(image_nodes.select("node", F.lit(1).alias("is_image")), "node", "left")
    total = reach.groupBy("source").agg(F.count(F.lit(1)).alias("nodes"), F.count("is_image").alias("downstream"))
    direct = starts.groupBy("source").agg(F.count_distinct("node").alias("direct"))
    return total.join(direct, "source").withColumn("factor", F.bround(F.col("downstream") / F.col("direct"), 1))


def closure(parents: DataFrame, nodes: DataFrame | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(ancestor, node) pairs without self, of all nodes or of the given ones; each pair once, on cycles too."""
    up = parents.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node <> ancestor")
    start = up if nodes is None else up.join(nodes.select("node"), "node", "left_semi")
    frontier = kept(start.withColumn("mark", F.col("node")), "closure")
    out, cyclic = frontier.select("ancestor", "node"), False
    step = up.toDF("via", "next")
    for i in range(max_depth):
        walked = kept(frontier.join(step, F.col("ancestor") == F.col("via")).select("node", F.col("next").alias("ancestor"), "mark"), "closure")
        around = (F.col("ancestor") == F.col("mark")) | (F.col("ancestor") == F.col("node"))
        found = walked.agg(F.count_if(~around).alias("open"), F.count_if(around).alias("around")).first()
        cyclic = cyclic or found["around"] > 0
        if not found["open"]:
            return out.distinct() if cyclic else out
        walked = walked.where(~around)
        out = out.unionByName(walked.select("ancestor", "node"))
        frontier = walked.select("node", "ancestor", marked(i, "ancestor"))
    raise RuntimeError(f"chains of over {max_depth} nodes")


def signature_only(tags: DataFrame, keys: list[str]) -> DataFrame:
    """Repositories that have signature tags and no other."""
    is_ = signature_tag(F.col("tag"))
    return tags.groupBy(*keys).agg(F.bool_and(is_).alias("__only")).where("__only").select(*keys)


def representative_tags(tags: DataFrame) -> DataFrame:
    """(ns, repo, tag): 'latest' if the repository has it, else its most recent active tag, else its most recent one (dates as
    text; the first by seq of equals); signature tags don't count, and a repository that has no other gets 'latest'."""
    real = ~signature_tag(F.col("tag"))
    w = Window.partitionBy("ns", "repo").orderBy(F.col("is_latest").desc(), F.col("is_active").desc(), F.col("last_updated").desc(), "seq")
    ladder = tags.where(real).withColumn("is_latest", F.col("tag") == "latest").withColumn("is_active", F.coalesce(F.col("status") == "active", F.lit(False)))
    best = ladder.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("ns", "repo", "tag")
    return tags.select("ns", "repo").distinct().join(best, ["ns", "repo"], "left").withColumn("tag", F.coalesce("tag", F.lit("latest")))


def canonical(refs: DataFrame) -> DataFrame:
    """refs (node, pos, pull, ...) with is_canonical: the most pulled reference of the node, the first of equals."""
    return refs.withColumn("is_canonical", F.row_number().over(Window.partitionBy("node").orderBy(F.col("pull").desc(), "pos")) == 1)


def ranking(refs: DataFrame, owned: DataFrame, tags: DataFrame) -> DataFrame:
    """One row a repository: exposure is own pull, plus what its node inherits where it is the node's canonical reference;
    of several candidates the representative tag's wins, then the greater exposure, then the first."""
    rows = canonical(refs).join(owned, "node", "left")
    mine = lambda c: F.when(F.col("is_canonical"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    rows = rows.select("ns", "repo", "tag", "digest", "pull", "pos", "node", mine("downstream"), mine("dependency_weight")).withColumn("exposure", F.col("pull") + F.col("downstream"))
    rows = rows.join(tags.select("ns", "repo", F.col("tag").alias("best_tag")), ["ns", "repo"], "left").withColumn("matched", F.coalesce(F.col("tag") == F.col("best_tag"), F.lit(False)))
    w = Window.partitionBy("ns", "repo").orderBy(F.col("matched").desc(), F.col("exposure").desc(), "node", "pos")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("ns", "repo", "tag", "digest", "pull", "dependency_weight", "downstream", "exposure")


def expanded_prefixes(found: DataFrame, alphabet: str = "abcdefghijklmnopqrstuvwxyz0123456789-_", most: int = 10_000) -> DataFrame:
    """The prefix trie's next level: (prefix, count) with count >= most, or of one letter, grow by every letter, up to 255
    letters, never two separators in a row; priority 255 - length, -1 beyond."""
    grow = found.where(((F.col("count") >= most) | (F.length("prefix") == 1)) & (F.length("prefix") < 255))
    rows = grow.select("prefix", F.explode(F.array(*map(F.lit, alphabet))).alias("c")).where(~(F.substring("prefix", -1, 1).isin("-", "_") & F.col("c").isin("-", "_")))
    return rows.select(F.concat("prefix", "c").alias("prefix")).withColumn("priority", F.when(F.length("prefix") <= 255, 255 - F.length("prefix")).otherwise(-1))


def shards(alphabet: str, workers: int) -> list[str]:
    """Contiguous slices of the alphabet; the last worker takes the remainder."""
    size = len(alphabet) // workers
    return [alphabet[i * size : (i + 1) * size if i < workers - 1 else len(alphabet)] for i in range(workers)]
