"""Near copies by SimHash: two texts link if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.

A text's SimHash vector is the sum over its distinct shingles of DIMS signs, taken from the shingle's XXH64. The signs of
fixed integer combinations of it (rotations) give as many fingerprint bits as a search needs. Two texts of similarity s
have a cosine of at least 2s / (1 + s), so one bit is equal with a known probability.

Search. At 0.8 a seventh of all bits differ: a threshold on the whole distance would ask every partition for several
errors. The pigeonhole is therefore generalised from a bound to a probability. Correlated bits are grouped into partitions
of one width; each gets a threshold of -1 (unused), 0 or 1; a pair that differs in no more bits than the threshold of some
partition meets there. Dynamic programming over the partitions chooses the thresholds that cost least - rows emitted and
candidates, estimated from PLAN_SAMPLE texts' pairs - while a pair of similarity 0.8 is found with probability RECALL or
more (more similar ones still more surely). The width is the cheapest, so it grows with the number of texts.

Verification. Texts that meet are candidates if their sizes allow 0.8 and their first DIMS bits differ in at most SKETCH
places, three standard deviations above what is expected at 0.8. The similarity of candidates is then computed from the two
shingle sets, so no pair below 0.8 links.

First each text is compared with its NEAREST closest candidates and its least, which joins a group with few pairs a member.
Then texts that still have a candidate in another component are compared inside their buckets, all such pairs, each in the
first bucket that it shares; what leaves a bucket are links that join components, fewer than its members. Where more than
BLOCK texts meet, the first search cuts them by hash; the second compares those outside the largest component with each
other and with it, block by block, so no task holds more than two blocks and no pair is left out.

Defined cases: null and empty texts have no shingles and are copies of each other; a text of fewer than five words is one
shingle; letters A to Z count as small. Texts are known by their XXH64. A component keeps the rows of its smallest doc_id,
all of its rows if it has none; repeated rows of that id stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_texts, written
from .components import components

WIDTH = 5
#: At least this share, as a fraction, so that no rounding decides.
SHARE = (4, 5)
RECALL = 0.995
DIMS = 128
PLAN_SAMPLE = 1500
BLOCK = 4096
NEAREST = 4
#: A row is shuffled, a candidate pair is a few operations on arrays.
ROW_COST, PAIR_COST = 1.0, 0.004
_UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct XXH64 of the text's shingles, sorted."""
    words = (text or b"").translate(_UPPER_TO_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= WIDTH:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hash_ = xxhash.xxh64_intdigest
    n = len(words) - WIDTH + 1
    return np.unique(np.fromiter((hash_(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), ends[WIDTH - 1 :].tolist(), strict=True)), np.uint64, n))


def vector(own: np.ndarray) -> np.ndarray:
    """The sums of DIMS signs: the bits of the hash and of the hash mixed once more."""
    ones = np.zeros(DIMS, np.int64)
    for at in range(0, len(own), 4096):
        h = own[at : at + 4096]
        mixed = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        both = np.stack([h, mixed ^ (mixed >> np.uint64(31))], axis=1)
        ones += np.unpackbits(both.view(np.uint8).reshape(-1, DIMS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * ones - len(own)


def rotations(bits: int) -> np.ndarray:
    """(bits, DIMS) integers, the same for every number of bits as far as they go; products with vectors are exact doubles."""
    return np.random.default_rng(5).integers(-127, 128, (bits, DIMS)).astype(float)


def agreement(share: float = SHARE[0] / SHARE[1]) -> float:
    """The probability that a bit is equal at this similarity, one standard deviation of DIMS signs below the mean."""
    cosine = 2 * share / (1 + share)
    return 1 - math.acos(cosine - (1 - cosine**2) / math.sqrt(DIMS)) / math.pi


def sketch_bound() -> int:
    differ = 1 - agreement()
    return math.floor(DIMS * differ + 3 * math.sqrt(DIMS * differ * (1 - differ)))


SKETCH = sketch_bound()


@dataclass(frozen=True)
class Plan:
    width: int
    parts: tuple[tuple[tuple[int, ...], int], ...]  # bits and threshold of each partition used

    def keys(self, vectors: np.ndarray) -> np.ndarray | list[np.ndarray]:
        """The buckets of each text: its own in every partition, and where the threshold is 1 those one bit upwards."""
        bits = (vectors.astype(float) @ rotations(1 + max((max(own) for own, _ in self.parts), default=0)).T) > 0
        weights = np.int64(1) << np.arange(self.width, dtype=np.int64)
        fixed, upwards = [], []
        for i, (own, t) in enumerate(self.parts):
            mine = bits[:, list(own)]
            code = mine @ weights + (np.int64(i) << np.int64(44))
            fixed.append(code)
            if t:
                upwards.append(np.where(mine, np.int64(-1), code[:, None] + weights))
        fixed = np.stack(fixed, axis=1)
        if not upwards:
            return fixed
        more = np.concatenate(upwards, axis=1)
        return [np.concatenate([a, b[b >= 0]]) for a, b in zip(fixed, more, strict=True)]


def correlation(bits: np.ndarray) -> np.ndarray:
    centred = bits - bits.mean(axis=0) if len(bits) else bits
    scale = np.sqrt((centred**2).sum(axis=0))
    near = np.abs(centred.T @ centred) / np.maximum(np.outer(scale, scale), 1e-12)
    np.fill_diagonal(near, 0)
    return near


def grouped(near: np.ndarray, width: int) -> list[tuple[int, ...]]:
    """Groups of so many bits: each starts with the free bit that goes most with the others and takes its closest free bits."""
    free, out = np.ones(len(near), bool), []
    for _ in range(len(near) // width):
        close = np.where(free, near @ free, -np.inf)
        own: list[int] = []
        score = close
        for _ in range(width):
            b = int(np.argmax(np.where(free, score, -np.inf)))
            free[b] = False
            score = near[b] if not own else score + near[b]
            own.append(b)
        out.append(tuple(sorted(own)))
    return out


def planned(sample: np.ndarray, rows: int, recall: float = RECALL) -> Plan:
    """The cheapest thresholds for so many texts; sample: vectors of some of them. Any plan keeps the probability."""
    p, need = agreement(), -math.log(1 - recall)
    best: tuple[float, Plan] | None = None
    start = max(2, math.ceil(math.log2(max(rows, 2))) - 10)
    for width in range(start, min(40, start + 8)):
        caught = [0.0, p**width, p**width + width * (1 - p) * p ** (width - 1)]
        count = math.ceil(1.25 * need / -math.log1p(-caught[1])) + 1
        bits = ((sample.astype(float) @ rotations(count * width).T) > 0).astype(float)
        chunk = max(1, 512 // width) * width
        own_groups = [tuple(at + b for b in own) for at in range(0, count * width, chunk) for own in grouped(correlation(bits[:, at : at + chunk]), width)]
        steps = 2000  # of the logarithm of the probability to miss
        gain = [0, *(math.floor(-math.log1p(-c) / need * steps) for c in caught[1:])]
        # table[s]: least cost of the partitions so far that reach s steps or more
        table, choice = np.full(steps + 1, np.inf), []
        table[0] = 0
        reach = [np.maximum(np.arange(steps + 1) - g, 0) for g in gain]
        for own in own_groups:
            codes = bits[:, list(own)] @ (2.0 ** np.arange(width))
            _, times = np.unique(codes, return_counts=True)
            met = max(float((times * (times - 1)).sum()) / max(len(bits) * (len(bits) - 1), 1), 2.0**-width)
            cost = [0.0] + [rows * e * ROW_COST + rows * rows * met * f / 2 * PAIR_COST for e, f in ((1, 1), (1 + width / 2, 1 + width))]
            options = np.stack([table[at] + c for at, c in zip(reach, cost, strict=True)])
            choice.append(options.argmin(axis=0))
            table = options.min(axis=0)
        if not np.isfinite(table[steps]) or (best and table[steps] >= best[0]):
            continue
        best = (float(table[steps]), Plan(width, traced(own_groups, choice, gain, steps)))
    assert best is not None
    return best[1]


def traced(own_groups: list[tuple[int, ...]], choice: list[np.ndarray], gain: list[int], steps: int) -> tuple[tuple[tuple[int, ...], int], ...]:
    """Thresholds back from the last partition."""
    parts, left = [], steps
    for own, chosen in zip(reversed(own_groups), reversed(choice), strict=True):
        k = int(chosen[left])
        if k:
            parts.append((own, k - 1))
            left = max(0, left - gain[k])
    return tuple(reversed(parts))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both)


def node(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def vectors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """node, doc_id, n (shingles), signs (the first DIMS bits, as two numbers) and the vector."""

    def make(texts: list[bytes | None]) -> list:
        sets = [shingles(t) for t in texts]
        own = np.stack([vector(s) for s in sets]) if sets else np.zeros((0, DIMS), np.int64)
        signs = np.packbits(own > 0, axis=1).view(">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(np.ascontiguousarray(signs[:, 0])), pa.array(np.ascontiguousarray(signs[:, 1])), pa.array([v.astype("<i4").tobytes() for v in own], pa.binary())]

    return map_texts(docs, [node(text).alias("node"), F.col(key).alias("doc_id")], make, "n bigint, s1 bigint, s2 bigint, vector binary", text)


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, DIMS)


def members(rows: DataFrame, plan: Plan) -> DataFrame:
    """key, node, n, s1, s2: a row for each bucket of each text. rows: node, n, s1, s2, vector. With a component in rows that
    follows, and all keys of the text (empty where partitions give different numbers of them)."""
    names = ["key", "node", "n", "s1", "s2"]
    with_component = "component" in rows.columns
    names += ["component", "keys"] if with_component else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                b = batch.slice(first, 1000)
                keys = plan.keys(unpacked(b.column(4)))
                sizes = np.full(b.num_rows, keys.shape[1]) if isinstance(keys, np.ndarray) else np.array([len(k) for k in keys])
                flat = keys.ravel() if isinstance(keys, np.ndarray) else np.concatenate(keys)
                own = np.repeat(np.arange(b.num_rows), sizes)
                cols = [pa.array(flat), *(b.column(i).take(pa.array(own)) for i in range(4))]
                if with_component:
                    every = [k.astype("<i8").tobytes() for k in keys] if isinstance(keys, np.ndarray) else [b""] * b.num_rows
                    cols += [b.column(5).take(pa.array(own)), pa.array(every, pa.binary()).take(pa.array(own))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    extra = ["component"] if with_component else []
    return rows.select("node", "n", "s1", "s2", "vector", *extra).mapInArrow(run, "key bigint, node bigint, n bigint, s1 bigint, s2 bigint" + (", component bigint, keys binary" if extra else ""))


def groups(batches: Iterator[pa.RecordBatch], own: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows that agree in the first ``own`` columns, for runs of two rows or more."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        changes = np.flatnonzero(np.any(np.stack([c[1:] != c[:-1] for c in cols[:own]]), axis=0)) + 1
        at = np.concatenate([[0], changes])
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if j - i > 1:
                yield [c[i:j] for c in cols]
        held = [c[at[-1] :] for c in cols]
    if held is not None and len(held[0]) > 1:
        yield held


def close(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of the given rows: (rows, distance to all; beyond SKETCH where sizes or signs rule a link out)."""
    for at in range(0, len(rows), 256):
        own = rows[at : at + 256]
        distance = np.bitwise_count(s1[own, None] ^ s1[None, :]).astype(np.int16) + np.bitwise_count(s2[own, None] ^ s2[None, :])
        small, large = np.minimum(n[own, None], n[None, :]), np.maximum(n[own, None], n[None, :])
        distance[SHARE[1] * small < SHARE[0] * large] = DIMS + 1
        distance[np.arange(len(own)), own] = DIMS + 1
        yield own, distance


def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, d): each member's NEAREST closest candidates of the bucket, and its least."""
    for _, _, nodes, n, s1, s2 in groups(batches, 2):
        a, b, d = [], [], []
        order = np.argsort(nodes, kind="stable")
        nodes, n, s1, s2 = nodes[order], n[order], s1[order].view(np.uint64), s2[order].view(np.uint64)
        some = min(NEAREST, len(nodes) - 1)
        for own, distance in close(n, s1, s2, np.arange(len(nodes))):
            near = np.argpartition(distance, some, axis=1)[:, :some] if some < len(nodes) - 1 else np.argsort(distance, axis=1)[:, :some]
            for at in (*near.T, (distance <= SKETCH).argmax(axis=1)):
                far = distance[np.arange(len(own)), at]
                ok = far <= SKETCH
                a.append(nodes[own][ok])
                b.append(nodes[at][ok])
                d.append(far[ok].astype(np.int32))
        if any(map(len, a)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, d)], names=["a", "b", "d"])


def unconnected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, x, y, node, component): members of a bucket (or of two blocks of it) that have a candidate there in another
    component, each pair of texts counted in the first bucket that it shares."""
    for key, x, y, nodes, n, s1, s2, component, keys in groups(batches, 3):
        kinds, of, times = np.unique(component, return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            continue
        s1, s2 = s1.view(np.uint64), s2.view(np.uint64)
        every = np.frombuffer(b"".join(keys), "<i8").reshape(len(nodes), -1)
        marked = np.zeros(len(nodes), bool)
        for own, distance in close(n, s1, s2, np.flatnonzero(of != times.argmax())):
            i, j = np.nonzero((distance <= SKETCH) & (of[own, None] != of[None, :]))
            i = own[i]
            if every.shape[1]:
                first = np.concatenate([(every[i[k : k + 4096]] == every[j[k : k + 4096]]).argmax(axis=1) for k in range(0, len(i), 4096)] or [np.zeros(0, np.int64)])
                here = every[i, first] == key[0]
                i, j = i[here], j[here]
            marked[i] = marked[j] = True
        if marked.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[marked]) for c in (key, x, y, nodes, component)], names=["key", "x", "y", "node", "component"])


def connecting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): links that connect the components that pairs of the bucket's members connect, by exact similarity. Columns: key, x, y, node, component, shingles.

    A member's shingles and their other owners give its similarity with all members at once; a link is kept only if it joins
    two components, so there are fewer links than members.
    """
    for _, _, _, nodes, component, packed in groups(batches, 3):
        sets = [np.frombuffer(p, np.uint64) for p in packed]
        n = np.array([len(p) for p in sets], np.int64)
        label = np.unique(component, return_inverse=True)[1]
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(ids, kind="stable")
        owners = np.repeat(np.arange(len(n)), n)[order]
        start = np.searchsorted(ids[order], np.arange(int(ids.max(initial=-1)) + 2))
        at = np.concatenate([[0], np.cumsum(n)])
        a, b = [], []
        for i in range(len(n)):
            if (label == label[0]).all():
                break
            own = ids[at[i] : at[i + 1]]
            sizes = start[own + 1] - start[own]
            places = np.repeat(start[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            both = np.bincount(owners[places], minlength=len(n))
            alike_ = (SHARE[1] * both >= SHARE[0] * (n[i] + n - both)) & (label != label[i])
            for k in np.unique(label[alike_]).tolist():
                a.append(nodes[i])
                b.append(nodes[np.flatnonzero(alike_ & (label == k))[0]])
                label[label == k] = label[i]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a)), pa.array(np.array(b))], names=["a", "b"])


def grouped_by(rows: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def first_pairs(rows: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(a, b): each text's closest candidates and its least, over all buckets; and (key, m): crowded buckets, cut by hash here."""
    met = members(rows, plan)
    crowded = written(members(rows, plan).groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK), "crowded")
    cut = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK)), F.lit(0)).cast("bigint")
    if crowded.count():
        met = joined(met, crowded, "key", "left").withColumn("cut", cut)
    else:
        met = met.withColumn("cut", F.lit(0).cast("bigint"))
    found = grouped_by(met.select("key", "cut", "node", "n", "s1", "s2"), ["key", "cut"], nearest, "a bigint, b bigint, d int")
    # a few of each bucket
    found = found.groupBy("a").agg(F.array_sort(F.collect_set(F.struct("d", "b"))).alias("x"), F.min("b").alias("y"))
    pairs = found.select("a", F.explode(F.concat(F.slice(F.col("x.b"), 1, NEAREST), F.array("y"))).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), crowded


def joined(rows: DataFrame, few: DataFrame, key: str, how: str) -> DataFrame:
    """Broadcast behind a check of the size, a merge join beyond it."""
    return rows.join(F.broadcast(few) if few.count() <= 100_000 else few.hint("merge"), key, how)


def open_links(rows: DataFrame, plan: Plan, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect what candidate pairs of texts in different components connect. rows: with component."""
    met = members(rows, plan)
    sizes = members(rows, plan).groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.groupBy("key").agg(F.sum("m").alias("m"), F.max(F.struct("m", "component")).alias("most"))
    crowded = written(sizes.where((F.col("m") > BLOCK) & (F.col("most.m") < F.col("m"))).select("key", F.col("most.component").alias("most"), F.ceil((F.col("m") - F.col("most.m")) / BLOCK).alias("outer"), F.ceil(F.col("most.m") / BLOCK).alias("inner")), "crowded")
    columns = ["key", "x", "y", "node", "n", "s1", "s2", "component", "keys"]
    zero = F.lit(0).cast("bigint")
    if not crowded.count():
        spread = met.withColumn("x", zero).withColumn("y", zero)
    else:
        met = joined(met, crowded, "key", "left")
        # outer block i meets outer blocks j >= i as (i, j) and inner block j as (i, -1 - j)
        outer = F.pmod(F.xxhash64("node"), F.col("outer"))
        pair = lambda a, b: F.struct(a.cast("bigint").alias("x"), b.cast("bigint").alias("y"))
        up_to = lambda n: F.sequence(zero, F.col(n) - 1)
        as_outer = F.concat(F.transform(up_to("outer"), lambda j: pair(F.least(outer, j), F.greatest(outer, j))), F.transform(up_to("inner"), lambda j: pair(outer, -1 - j)))
        as_inner = F.transform(up_to("outer"), lambda i: pair(i, -1 - F.pmod(F.xxhash64("node"), F.col("inner"))))
        places = F.when(F.col("outer").isNull(), F.array(pair(zero, zero))).when(F.col("component") == F.col("most"), as_inner).otherwise(as_outer)
        spread = met.withColumn("__at", F.explode(places)).withColumn("x", F.col("__at.x")).withColumn("y", F.col("__at.y"))
    by = ["key", "x", "y"]
    some = written(grouped_by(spread.select(*columns), by, unconnected, "key bigint, x bigint, y bigint, node bigint, component bigint"), "open-members")
    own = some.join(sets.hint("merge"), "node").select(*by, "node", "component", "shingles")
    return grouped_by(own, by, connecting, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i) for i in (2, 3))
            keep = [alike(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64)) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.toDF(c, f"s{c}").hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def shingle_sets(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """node, shingles of the given nodes."""
    some = docs.select(node(text).alias("node"), F.col(text).alias("text")).join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    return map_texts(some, [F.col("node")], lambda texts: [[shingles(t).tobytes() for t in texts]], "shingles binary")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def links(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """Links (a, b) between nodes that connect what chains of found pairs connect. rows: vectors(docs)."""
    texts = rows.select("node", "n", "s1", "s2", "vector").dropDuplicates(["node"])
    texts = written(texts, "distinct-vectors")
    count = texts.count()
    draw = F.pmod(F.xxhash64(F.lit("plan"), "node"), F.lit(1 << 30)) < F.lit(int(min(1.0, PLAN_SAMPLE / max(count, 1)) * (1 << 30)))
    sample = texts.where(draw).orderBy("node").limit(2 * PLAN_SAMPLE).select("vector").collect()  # PLAN_SAMPLE vectors or so
    plan = planned(np.frombuffer(b"".join(r["vector"] for r in sample), "<i4").reshape(-1, DIMS), count)
    first, crowded = first_pairs(texts, plan)
    first = written(first, "first-pairs")
    some = ends(first)  # a text that has a candidate in a bucket that wasn't cut is here
    if crowded.count():
        some = some.unionByName(joined(members(texts, plan), crowded, "key", "left_semi").select("node")).distinct()
    some = written(some, "candidates")
    sets = written(shingle_sets(docs, some, text), "shingle-sets")
    sure = written(verified(first, sets), "first-links")
    left = texts.join(some.hint("merge"), "node").join(components(sure).hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return sure.unionByName(written(open_links(written(left, "open"), plan, sets), "open-links"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """node, keep: the texts that have copies or near copies, and the smallest doc_id of their component."""
    bounded_batches(docs.sparkSession)
    rows = written(vectors(docs, key, text), "vectors")
    found = components(links(docs, rows, text))
    rows = written(rows.select("node", "doc_id").join(found.hint("merge"), "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")), "classes")
    named = rows.groupBy("component").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("m")).where("m > 1 AND keep IS NOT NULL").select("component", "keep")
    return written(rows.select("node", "component").distinct().join(named.hint("merge"), "component").select("node", "keep"), "near-copies")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the near copies of others."""
    found = near_copies(docs, key, text).select(F.col("node").alias("__node"), F.col("keep").alias("__keep"))
    # never broadcast, so the plan is one and the same at every size
    rows = docs.join(found.hint("merge"), node(text) == F.col("__node"), "left")
    return rows.where(F.col("__node").isNull() | F.col(key).eqNullSafe(F.col("__keep"))).select(*docs.columns)
