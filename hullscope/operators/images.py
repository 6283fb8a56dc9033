"""What is derived from image metadata: start files, job references, layers that merge, results that are reused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a start command is stripped down to the file that it runs.
SHELL, START_FILE = r"^/bin/sh\s+-c\s+", r"^(?:python\s+|./)?(\S+)"


def start_file(entrypoint: Column, cmd: Column, workdir: Column) -> Column:
    """The file that an image runs by default, absolute; null without a command. entrypoint, cmd: arrays of words."""
    words = lambda x: F.trim(F.array_join(F.coalesce(x, F.array().cast("array<string>")), " "))
    first, rest = words(entrypoint), words(cmd)
    whole = F.when(first != "", F.concat(first, F.lit(" "), rest)).otherwise(rest)
    bare = F.when(whole.startswith("/bin/sh -c"), F.regexp_replace(whole, SHELL, "")).otherwise(whole)
    file = F.regexp_extract(bare, START_FILE, 1)
    base = F.regexp_replace(F.coalesce(F.nullif(workdir, F.lit("")), F.lit("/")), "/+$", "")
    return F.when(file == "", F.lit(None).cast("string")).when(file.startswith("/"), file).otherwise(F.concat(base, F.lit("/"), file))


def job_image(image: Column) -> Column:
    """struct(ns, repo, tag, digest) of '[ns/]repo[:tag]@digest', null if there is no '@'."""
    left, digest = F.regexp_extract(image, r"^(.*)@([^@]*)$", 1), F.regexp_extract(image, r"^(.*)@([^@]*)$", 2)
    tagged = F.contains(left, F.lit(":"))
    path = F.ltrim(F.when(tagged, F.regexp_extract(left, r"^(.*):([^:]*)$", 1)).otherwise(left), F.lit("/"))
    tag = F.when(tagged, F.regexp_extract(left, r"^(.*):([^:]*)$", 2)).otherwise(F.lit("latest"))
    deep = F.contains(path, F.lit("/"))
    ns = F.when(deep, F.regexp_extract(path, r"^([^/]*)/(.*)$", 1)).otherwise(F.lit("library"))
    repo = F.when(deep, F.regexp_extract(path, r"^([^/]*)/(.*)$", 2)).otherwise(path)
    return F.when(F.contains(image, F.lit("@")), F.struct(ns.alias("ns"), repo.alias("repo"), tag.alias("tag"), digest.alias("digest")))


def merged_layers(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Issues of a whole image from those of its layers: (image, layer, path, kind, ...).

    files: (image, layer, path, clean), what each layer does to a path that some layer has an issue in; a path whose last
    word is clean was mended and loses its issues. Of the others the highest layer with a row for the path counts, with all
    of that layer's rows, across kinds; components aren't mended, and secrets are kept from every layer.
    """
    secrets = issues.where("kind = 'secret'")
    others = issues.where("kind <> 'secret'")
    last = files.groupBy("image", "path").agg(F.max_by("clean", "layer").alias("mended"))
    open_ = others.join(last, ["image", "path"], "left").where((F.col("kind") == "component") | ~F.coalesce("mended", F.lit(False))).drop("mended")
    top = open_.groupBy("image", "path").agg(F.max("layer").alias("layer"))
    return open_.join(top, ["image", "path", "layer"], "left_semi").unionByName(secrets)


def reused_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests (ns, repo, tag, digest, params) with the result they need not compute: source is 'own' where the very
    reference was analysed, 'digest' where another reference of its digest was (its repository's params are the request's),
    'new' otherwise. results: (ns, repo, tag, digest, analysed, issues, params, seq); of several the first by seq."""
    whole = results.where("analysed")
    own = whole.groupBy("ns", "repo", "tag", "digest").agg(F.min_by(F.struct("issues", "params"), "seq").alias("own"))
    any_ = whole.where("digest <> ''").groupBy("digest").agg(F.min_by("issues", "seq").alias("other"))
    rows = requests.join(own, ["ns", "repo", "tag", "digest"], "left").join(any_, "digest", "left")
    source = F.when(F.col("own").isNotNull(), "own").when(F.col("other").isNotNull(), "digest").otherwise("new")
    return rows.select("ns", "repo", "tag", "digest", source.alias("source"), F.coalesce("own.issues", "other").alias("issues"), F.when(F.col("own").isNotNull(), F.col("own.params")).otherwise(F.col("params")).alias("params"))


def components_of(matches: DataFrame) -> DataFrame:
    """(image, name, version, path, language, type): each of an image once; a match has an array of locations."""
    rows = matches.select("image", "seq", "name", "version", F.explode("paths").alias("path"), "language", "type")
    return rows.groupBy("image", "name", "version", "path").agg(F.min_by(F.struct("language", "type"), F.struct("seq", "language", "type")).alias("x")).select("image", "name", "version", "path", "x.language", "x.type")


def match_scores(matches: DataFrame) -> DataFrame:
    """(image, id, path, cvss): the first score and the first location of each match; null where it has none."""
    return matches.select("image", "id", F.try_element_at("paths", F.lit(1)).alias("path"), F.try_element_at("scores", F.lit(1)).alias("cvss"))


def raw_layers(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw layers: digest with the first size and instruction by seq; links: node, digest) of nodes (node, digest, size, instruction, seq); an empty digest has no raw layer."""
    own = nodes.where("digest <> ''")
    raw = own.groupBy("digest").agg(F.min_by(F.struct("size", "instruction"), "seq").alias("x")).select("digest", "x.size", "x.instruction")
    return raw, own.select("node", "digest").distinct()


def source_nodes(links: DataFrame, parents: DataFrame, image_nodes: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(digest, node): below each node of a raw layer (links: node, digest) the nearest nodes that images end at, itself first.

    A frontier walks down until it meets such a node; a branch ends there, so every node is visited once for a digest's node.
    """
    from .checkpoint import kept

    ends = image_nodes.select("node").distinct().withColumn("__end", F.lit(True))
    down = parents.select(F.col("parent").alias("__parent"), "child")
    frontier, out = links.select("digest", F.col("node").alias("start"), "node").distinct(), None
    for _ in range(max_depth):
        seen = kept(frontier.join(ends, "node", "left"), "sources")
        hit = seen.where("__end").select("digest", "start", "node")
        out = hit if out is None else out.unionByName(hit)
        frontier = seen.where("__end IS NULL").join(down, F.col("node") == F.col("__parent")).select("digest", "start", F.col("child").alias("node"))
        if frontier.isEmpty():
            return out.select("digest", "node").distinct()
    raise RuntimeError(f"chains of over {max_depth} nodes")


def exposed_nodes(nodes: DataFrame, parents: DataFrame, image_nodes: DataFrame) -> DataFrame:
    """(node, ports): of every node that images end at the distinct EXPOSE instructions of itself and the nodes above it."""
    from .graph import reachable

    starts = nodes.where(F.col("instruction").startswith("EXPOSE")).select(F.col("instruction").alias("source"), "node")
    found = reachable(starts, parents).join(image_nodes.select("node").distinct(), "node", "left_semi")
    return found.groupBy("node").agg(F.array_sort(F.collect_set("source")).alias("ports"))  # a node's own few


def digests_to_nodes(refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, node) of wanted digests: of a digest that several nodes have the last by seq counts."""
    return refs.join(wanted.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.max_by("node", "seq").alias("node"))


def top_propagation(reached: DataFrame, package: str = "zlib", most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(the rows with most downstream, one row: their least and greatest downstream and factor, and the downstream of the first of the package)."""
    top = reached.orderBy(F.col("downstream").desc(), "source").limit(most)
    ends = top.agg(F.min("downstream").alias("downstream_min"), F.max("downstream").alias("downstream_max"), F.min("factor").alias("factor_min"), F.max("factor").alias("factor_max"), F.max_by(F.when(F.col("package") == package, F.col("downstream")), F.when(F.col("package") == package, F.struct("downstream", "source"))).alias("of_package"))
    return top, ends


def build_claim(repositories: DataFrame, threshold: int, count: int, now: float) -> DataFrame:
    """The most pulled repositories that aren't built or claimed, count of them, become claimed. count is the caller's, and small."""
    free = (F.col("pull_count") >= threshold) & F.col("graph_built_at").isNull() & ~F.coalesce("build_claimed", F.lit(False))
    chosen = repositories.where(free).orderBy(F.col("pull_count").desc(), "ns", "repo").limit(count).select("ns", "repo", F.lit(True).alias("__mine"))
    rows = repositories.join(F.broadcast(chosen) if count <= 100_000 else chosen, ["ns", "repo"], "left")
    mine = F.coalesce("__mine", F.lit(False))
    return rows.withColumn("build_claimed", mine | F.coalesce("build_claimed", F.lit(False))).withColumn("build_started_at", F.when(mine, F.lit(now)).otherwise(F.col("build_started_at"))).drop("__mine").select(*repositories.columns)


def build_done(repositories: DataFrame, built: DataFrame, at: float) -> DataFrame:
    """Built repositories (ns, repo) get their time and lose their claim."""
    rows = repositories.join(built.select("ns", "repo").distinct().withColumn("__done", F.lit(True)), ["ns", "repo"], "left")
    done = F.coalesce("__done", F.lit(False))
    return rows.withColumn("graph_built_at", F.when(done, F.lit(at)).otherwise(F.col("graph_built_at"))).withColumn("build_claimed", F.when(done, False).otherwise(F.col("build_claimed"))).withColumn("build_started_at", F.when(~done, F.col("build_started_at"))).drop("__done").select(*repositories.columns)


def build_reset(repositories: DataFrame) -> DataFrame:
    """Claims that no build followed are free again."""
    stale = F.coalesce("build_claimed", F.lit(False)) & F.col("graph_built_at").isNull()
    return repositories.withColumn("build_started_at", F.when(~stale, F.col("build_started_at"))).withColumn("build_claimed", F.when(stale, False).otherwise(F.col("build_claimed")))


def unique_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that several rows have, with how many: empty if the table's key holds."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
