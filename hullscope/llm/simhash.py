"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits over word shingles, a bit is 1 if set in over half of the shingles' XXH64. Two fingerprints link
if at most ``distance`` (2) bits differ.

Search. Bits that go together are grouped into m partitions. Thresholds t_1..t_m with sum = distance - m + 1 cover every
pair within distance: one partition at least differs in t_i bits or fewer (t_i = -1 drops a partition). m and the
thresholds are chosen by dynamic programming over estimated costs: rows emitted as probes plus candidates to verify,
estimated from a sample of PLAN_SAMPLE distinct fingerprints (the plan decides speed only; any plan finds every pair).
Each distinct fingerprint goes into the bucket of its own value in every partition kept, and where t_i = 1 also probes
the buckets one bit upwards, so that a pair one bit apart meets once.

A bucket of up to BUCKET members is verified in one task with vectorised XOR and yields only a spanning set of links.
Members of larger buckets (groups of near copies, common values) aren't compared with each other: two fingerprints are
within two bits exactly if they share a value one bit or none away from both, so each member is grouped by its 65 such
values and linked with the smallest of the group. A value is shared by 65 distinct fingerprints at most, so no group is
large and no pair is lost. Equal fingerprints are joined before the search.

Defined cases: null and empty texts have fingerprint zero, and link like any other. A component is named by its
smallest doc_id; null doc_ids join components but never name one that has another member. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written
from .components import components

SHINGLE = 3
DISTANCE = 2
BUCKET = 400
PLAN_SAMPLE = 3000
_UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A probe row is shuffled, a candidate pair is one XOR in an array.
PROBE_COST, PAIR_COST = 1.0, 0.02


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    words = (text or b"").translate(_UPPER_TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed=42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hash_ = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_(joined[i:j], 42) for i, j in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, keys: list[Column], text: str = "text", width: int = SHINGLE) -> DataFrame:
    """keys and fp (bigint: the 64 bits, signed)."""
    return map_texts(docs, keys, lambda texts: [pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))], "fp bigint", text)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def plan(sample: np.ndarray, rows: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """[(mask, threshold)] of the partitions to probe, thresholds 0 or 1, for so many distinct fingerprints."""
    fps = np.unique(sample.astype(np.uint64))
    bits = ((fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    if len(fps) > 2:
        centred = bits - bits.mean(axis=0)
        scale = np.sqrt((centred**2).sum(axis=0))
        near = np.abs(centred.T @ centred) / np.maximum(np.outer(scale, scale), 1e-12)
    else:
        near = np.zeros((64, 64))
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for m in range(2, distance + 2):
        masks = [sum(1 << b for b in own) for own in grouped(near, m)]
        cost = [[costs(fps, mask, t, rows) for t in (-1, 0, 1)] for mask in masks]
        # table[s]: least cost of the partitions so far with thresholds that sum to s
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for own in cost:
            table = min_by_sum((s + t, c + own[t + 1], [*path, t]) for s, (c, path) in table.items() for t in (-1, 0, 1))
        total, path = table.get(distance - m + 1, (float("inf"), []))
        if total < best[0]:
            best = (total, [(mask, t) for mask, t in zip(masks, path, strict=True) if t >= 0])
    return best[1]


def min_by_sum(found: Iterator[tuple[int, float, list[int]]]) -> dict[int, tuple[float, list[int]]]:
    out: dict[int, tuple[float, list[int]]] = {}
    for s, c, path in found:
        if s not in out or (c, path) < out[s]:
            out[s] = (c, path)
    return out


def grouped(near: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equal width: each starts with a bit that is far from the others and takes its closest free bits."""
    free, out = list(range(64)), []
    for i in range(m):
        width = (64 - sum(map(len, out))) // (m - i)
        own = [max(free, key=lambda b: (near[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < width:
            nxt = max(free, key=lambda b: (near[b, own].mean(), -b))
            own.append(nxt)
            free.remove(nxt)
        out.append(own)
    return out


def costs(fps: np.ndarray, mask: int, t: int, rows: int) -> float:
    """Estimated cost of probing one partition with threshold t: rows emitted, and candidates by the sample's pairs."""
    if t < 0:
        return 0.0
    width = mask.bit_count()
    probes = 1 + (width / 2 if t else 0)
    by_chance = (1 + (width if t else 0)) / 2.0**width
    part = fps & np.uint64(mask)
    close = pairs = 0
    for i in range(0, len(part), 256):
        d = popcount(part[i : i + 256, None] ^ part[None, :])
        close += int((d <= t).sum()) - len(d)
        pairs += d.size - len(d)
    rate = max(close / max(pairs, 1), by_chance)
    return rows * probes * PROBE_COST + rows * rows * rate / 2 * PAIR_COST


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def probes(fps: DataFrame, chosen: list[tuple[int, int]]) -> DataFrame:
    """(part, bucket, fp, own): own is false where the bucket is one bit above the fingerprint's own value."""
    parts = []
    for i, (mask, t) in enumerate(chosen):
        own = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        keys = [F.struct(F.lit(i).alias("part"), own.alias("bucket"), F.lit(True).alias("own"))]
        if t:
            keys += [F.when(own.bitwiseAND(F.lit(signed(1 << b))) == 0, F.struct(F.lit(i).alias("part"), own.bitwiseOR(F.lit(signed(1 << b))).alias("bucket"), F.lit(False).alias("own"))) for b in range(64) if mask >> b & 1]
        parts.append(F.array(*keys))
    rows = fps.select("fp", F.explode(F.filter(F.concat(*parts), lambda x: x.isNotNull())).alias("x"))
    return rows.select("x.part", "x.bucket", "fp", "x.own")


def spanning(fps: np.ndarray, own: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between members of a bucket within distance, of which one at least is at home there: enough to connect what they connect."""
    label = np.arange(len(fps))
    out = []
    for i in range(len(fps)):
        close = (popcount(fps ^ fps[i]) <= distance) & (own | own[i])
        for j in np.flatnonzero(close[:i]):
            if label[i] != label[j]:
                out.append((int(fps[i].view(np.int64)), int(fps[j].view(np.int64))))
                label[label == label[i]] = label[j]
    return out


def verified(buckets: DataFrame, distance: int) -> DataFrame:
    """buckets: members array<struct<fp, own>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat = column.flatten()
            fps, own = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            found = [x for i, j in zip(at[:-1], at[1:], strict=True) for x in spanning(fps[i:j].view(np.uint64), own[i:j].astype(bool), distance)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return buckets.mapInArrow(run, "a bigint, b bigint")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints (fp) that chains of pairs within distance connect."""
    rows = fps.count()
    draw = F.pmod(F.xxhash64(F.lit("plan"), "fp"), F.lit(1 << 30)) < F.lit(int(min(1.0, PLAN_SAMPLE / max(rows, 1)) * (1 << 30)))
    sample = np.array([r["fp"] for r in fps.where(draw).limit(4 * PLAN_SAMPLE).collect()], np.int64)
    emitted = probes(fps, plan(sample.view(np.uint64), rows, distance))
    large = written(emitted.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("part", "bucket"), "buckets")
    if large.count() <= 10_000:  # else as plain joins
        large = F.broadcast(large)
    small = emitted.join(large, ["part", "bucket"], "left_anti").groupBy("part", "bucket").agg(F.collect_list(F.struct("fp", "own")).alias("members")).where(F.size("members") > 1)
    crowd = emitted.join(large, ["part", "bucket"], "left_semi").select("fp").distinct()
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << b))) for b in range(64)))
    near = crowd.select("fp", F.explode(around).alias("value"))
    least = near.groupBy("value").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = least.select(F.explode(F.slice("fps", 2, 64)).alias("a"), F.col("fps")[0].alias("b"))
    if distance != 2:
        raise ValueError("large buckets are resolved for distance 2")
    return verified(small.select("members"), distance).unionByName(stars)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id, for every row of docs."""
    rows = written(fingerprints(docs, [F.col(key).alias("doc_id")], text, width), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    linked = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    linked = written(linked.join(fps, "fp").select("fp", "component", "least"), "components")
    named = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    of = written(fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the smallest doc_id of each component only (all of a component without one); repeated rows of that id stay."""
    found = written(near_duplicates(docs, key, text).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone")).where("__gone IS NOT NULL").distinct(), "near-duplicates")
    return docs.join(found, F.col(key) == F.col("__gone"), "left_anti")


def op4_rows(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def all_pairs_components(fps: list[int], distance: int = DISTANCE) -> list[int]:
    """Brute force, for tests: for each fingerprint the least index reachable."""
    label = list(range(len(fps)))
    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label
