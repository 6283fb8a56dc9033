"""Which scanners find the same: co-detection groups, overlaps, coverage, marginal gains and severity conflicts."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.severity import severity_name, severity_rank
from ..functions.text import ecosystem_class
from .findings import SCANNERS

BITS = {s: 1 << i for i, s in enumerate(SCANNERS)}


def groups(findings: DataFrame) -> DataFrame:
    """(image, cve, package) with a mask of scanners, each scanner's worst rank (null: none), the group's worst, the first ecosystem.

    One aggregation: the mask is a bitwise or, so map-side partials carry a few longs for each group.
    """
    cves = F.when(F.size("cves") > 0, F.col("cves")).otherwise(F.array("id"))
    rows = findings.where((F.col("category") == "pkg-vuln") & F.col("scanner").isin(*SCANNERS)).select("image", "package", "scanner", "ecosystem", "seq", severity_rank(F.col("severity")).alias("rank"), F.explode(cves).alias("cve")).where("coalesce(cve, '') <> ''")
    bit = reduce(lambda acc, kv: acc.when(F.col("scanner") == kv[0], F.lit(kv[1])), BITS.items(), F)
    return rows.groupBy("image", "cve", "package").agg(
        F.bit_or(bit).alias("mask"), *(F.max(F.when(F.col("scanner") == s, F.col("rank"))).alias(f"rank_{s}") for s in SCANNERS), F.max("rank").alias("rank"), F.min_by("ecosystem", F.struct("seq", "ecosystem")).alias("ecosystem")
    )


def by_mask(rows: DataFrame) -> DataFrame:
    """The regions of the overlap: mask, scanners in it, groups."""
    return rows.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).withColumn("n_scanners", F.bit_count("mask"))


def coverage(regions: DataFrame) -> DataFrame:
    """For each set of scanners: groups that one of them finds, and their share; on the seven rows of by_mask."""
    sets = [tuple(s) for k in range(1, len(SCANNERS) + 1) for s in combinations(SCANNERS, k)]
    sums = [F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(sum(BITS[x] for x in s))) != 0, F.col("n"))), F.lit(0)).alias("+".join(s)) for s in sets]
    row = regions.agg(F.sum("n").alias("total"), *sums)
    return row.select("total", F.inline(F.array(*(F.struct(F.lit("+".join(s)).alias("scanners"), F.col(f"`{'+'.join(s)}`").alias("n")) for s in sets)))).select("scanners", "n", F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("total")), F.lit(0.0)).alias("pct"))


def marginal(regions: DataFrame) -> DataFrame:
    """The gain of the k-th scanner, averaged over all orders in which scanners can be added, and the running share."""
    orders = list(permutations(SCANNERS))
    masks = [[sum(BITS[x] for x in o[:k]) for k in range(len(o) + 1)] for o in orders]
    covered = lambda m: F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(m)) != 0, F.col("n"))), F.lit(0))
    gains = [reduce(lambda a, b: a + b, (covered(m[k]) - covered(m[k - 1]) for m in masks)) / float(len(orders)) for k in range(1, len(SCANNERS) + 1)]
    row = regions.agg(F.sum("n").alias("total"), *(g.alias(f"g{k + 1}") for k, g in enumerate(gains)))
    rows = row.select("total", F.inline(F.array(*(F.struct(F.lit(k + 1).alias("k"), F.col(f"g{k + 1}").alias("gain"), reduce(lambda a, b: a + b, (F.col(f"g{j + 1}") for j in range(k + 1))).alias("upto")) for k in range(len(SCANNERS))))))
    return rows.select("k", "gain", F.coalesce(F.try_divide(F.col("gain") * 100.0, F.col("total")), F.lit(0.0)).alias("pct"), F.coalesce(F.try_divide(F.col("upto") * 100.0, F.col("total")), F.lit(0.0)).alias("cumulative_pct"))


def agreement_by(rows: DataFrame, what: str) -> DataFrame:
    """Percent of groups with one, two and three scanners, by 'severity' or by 'class' of ecosystem."""
    key = severity_name(F.col("rank")) if what == "severity" else ecosystem_class(F.col("ecosystem"))
    n = F.bit_count("mask")
    share = lambda k: (F.count_if(n == k) * 100.0 / F.count(F.lit(1))).alias(("single", "two", "three")[k - 1])
    return rows.groupBy(key.alias(what)).agg(F.count(F.lit(1)).alias("n"), share(1), share(2), share(3))


def confusion(rows: DataFrame) -> DataFrame:
    """Severity against severity for each two scanners that share a group: pairs come from the group's columns, not from a self-join."""
    pairs = [F.when(F.col(f"rank_{a}").isNotNull() & F.col(f"rank_{b}").isNotNull(), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"rank_{a}").alias("ra"), F.col(f"rank_{b}").alias("rb"))) for a, b in combinations(SCANNERS, 2)]
    own = rows.select(F.explode(F.array(*pairs)).alias("p")).where("p IS NOT NULL").select("p.*")
    return own.groupBy("a", "b", severity_name(F.col("ra")).alias("severity_a"), severity_name(F.col("rb")).alias("severity_b")).agg(F.count(F.lit(1)).alias("n"))


def mismatch(table: DataFrame) -> DataFrame:
    return table.groupBy("a", "b").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("severity_a") != F.col("severity_b"), F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("mismatch_pct"))


def all_and_distinct(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """Findings of the three scanners against distinct groups, by severity, with the ratio."""
    raw = findings.where((F.col("category") == "pkg-vuln") & F.col("scanner").isin(*SCANNERS)).groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
    own = rows.groupBy(severity_name(F.col("rank")).alias("severity")).agg(F.count(F.lit(1)).alias("groups"))
    return raw.join(own, "severity", "full").select("severity", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("groups", F.lit(0)).alias("groups"), F.try_divide(F.col("findings").cast("double"), F.col("groups").cast("double")).alias("ratio"))
