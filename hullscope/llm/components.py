"""Connected components of a table of links.

A set of at most SMALL links is solved by union-find in one task: a bound on that task's memory, counted first. A larger
one is solved by alternating large and small stars: every step is an aggregate with partial results and an equi-join, so a
hub (a component that holds a third of all nodes) is split by the map-side aggregate and by adaptive skew handling of the
join; no list of neighbours is ever built. Both give the same table. Each round is written to the shared folder twice, so
a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that one task may solve: 16 bytes each, and some 200 bytes for a node.
SMALL = 500_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link to another one.

    links may repeat, point either way or link a node with itself. An empty table gives an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    n = edges.count()
    if n <= SMALL:
        return written(edges.coalesce(1).mapInArrow(solved, "node bigint, component bigint"), "components")
    before = None
    while True:
        edges = written(large_star(edges), "links")
        edges = written(small_star(edges), "links")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == before:
            break
        before = (now["n"], now["s"])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes and, for each, the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    half = len(u)
    for i, j in zip(at[:half].tolist(), at[half:].tolist(), strict=True):
        i, j = root(i), root(j)
        if i != j:  # places are in order of the nodes, so the smaller place is the smaller node
            parent[max(i, j)] = min(i, j)
    return nodes, nodes[np.fromiter(map(root, range(len(nodes))), np.int64, len(nodes))]


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    nodes, least = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(least[i : i + 100_000])], names=["node", "component"])


def large_star(edges: DataFrame) -> DataFrame:
    """For each node u with smallest neighbour-or-self m: its larger neighbours get linked to m."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """For each node u with smallest smaller neighbour m: u and its other smaller neighbours get linked to m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
