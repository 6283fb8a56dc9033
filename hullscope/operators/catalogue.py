"""Catalogue lookups: joins with stated winners, all-or-nothing completeness, tag choice, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def ranked_reports(reports: DataFrame, ranking: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left join on keys (the ranking's first row by seq wins). A matched value stays, even 0; without a match the report's own one counts."""
    side = first_by(ranking, keys, [F.col("seq")]).select(*keys, *(F.col(v).alias(f"__{v}") for v in values), F.lit(True).alias("__match"))
    rows = reports.join(side, keys, "left")
    found = F.coalesce("__match", F.lit(False))
    return rows.select(*(c for c in reports.columns if c not in values), *(F.when(found, F.col(f"__{v}")).otherwise(F.coalesce(v, F.lit(0))).alias(v) for v in values), found.alias("matched"))


def complete_tags(tags: DataFrame, images: DataFrame) -> DataFrame:
    """tags: (tag, digest); images: (digest, layers). By tag: is every digest there, with layers? Tags without digests aren't complete."""
    known = images.groupBy("digest").agg(F.max("layers").alias("layers"))
    rows = tags.join(known, "digest", "left")
    return rows.groupBy("tag").agg(F.bool_and(F.coalesce(F.col("layers") > 0, F.lit(False))).alias("complete"), F.count("digest").alias("digests"))


def preferred(rows: DataFrame, keys: list[str], ok: Column, order: list[Column]) -> DataFrame:
    """Of several answers one that is ok, then by preference."""
    return first_by(rows.withColumn("__ok", ok.cast("int")), keys, [F.col("__ok").desc(), *order]).drop("__ok")


def reweigh(jobs: DataFrame, ranking: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs whose weight changes by 1 or more: keys, old and new weight; of a repeated key the ranking's highest counts."""
    new = ranking.groupBy(*keys).agg(F.max("exposure").alias("new_weight"))
    return jobs.join(new, keys).where(F.abs(F.col("weight") - F.col("new_weight")) >= 1).select(*keys, F.col("weight").alias("old_weight"), "new_weight")


def newest_tags(tags: DataFrame, n: int) -> DataFrame:
    """All tags of official repositories, the newest n of others."""
    from ..functions.text import is_official

    w = Window.partitionBy("ns", "repo").orderBy(F.col("updated").desc(), "image")
    return tags.withColumn("__r", F.row_number().over(w)).where((F.col("__r") <= n) | is_official(F.col("ns"))).drop("__r")


def graph_tags(tags: DataFrame) -> DataFrame:
    """Most recent tag of a repository, plus 'latest' if it has one, each once."""
    newest = tags.groupBy("ns", "repo").agg(F.max_by("tag", F.struct("updated", F.col("image"))).alias("tag"))
    return newest.unionByName(tags.where("tag = 'latest'").select("ns", "repo", "tag")).distinct()


def stale(images: DataFrame, created: str, pushed: str, updated: str) -> DataFrame:
    """Rows whose times aren't in the order created, pushed, updated."""
    return images.where((F.col(created) > F.col(pushed)) | (F.col(pushed) > F.col(updated)))


def network_services(exposed: DataFrame, repositories: DataFrame, tags: DataFrame, images: DataFrame) -> DataFrame:
    """Each exposed image with what is known of its repository, tag and image; each may be missing."""
    return exposed.join(repositories, ["ns", "repo"], "left").join(tags, ["ns", "repo", "tag"], "left").join(images, ["digest"], "left")


def job_targets(repositories: DataFrame, tags: DataFrame, threshold: int | None = None, newest: int | None = None, refresh: bool = False) -> DataFrame:
    """(ns, repo, tag) to analyse: of repositories (ns, repo, pull_count, analysed) over a pull threshold, if one is given, all
    tags or the newest few of each (tags: ns, repo, tag, updated); with refresh only tags newer than the repository's last analysis."""
    own = repositories if threshold is None else repositories.where(F.col("pull_count") > threshold)
    rows = tags.join(own.select("ns", "repo", "analysed"), ["ns", "repo"])
    if refresh:
        rows = rows.where(F.col("analysed").isNull() | (F.col("updated") > F.col("analysed")))
    if newest is not None:
        place = F.row_number().over(Window.partitionBy("ns", "repo").orderBy(F.col("updated").desc(), "tag"))
        rows = rows.withColumn("__r", place).where(F.col("__r") <= newest)
    return rows.select("ns", "repo", "tag")


def exported(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Results of the wanted references (ns, repo, tag, and digest where one is given)."""
    exact = results.join(wanted.where("coalesce(digest, '') <> ''").select("ns", "repo", "tag", "digest").distinct(), ["ns", "repo", "tag", "digest"], "left_semi")
    named = wanted.where("coalesce(digest, '') = ''").select("ns", "repo", "tag").distinct()
    loose = results.join(named, ["ns", "repo", "tag"], "left_semi")
    return exact.join(named, ["ns", "repo", "tag"], "left_anti").select(*results.columns).unionByName(loose.select(*results.columns))
