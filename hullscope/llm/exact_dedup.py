"""Exact deduplication: a two-pass Bloom filter finds the hashes that may occur twice; only their rows shuffle.

Pass one is dealt by hash: each task sends its distinct 64-bit hashes, 8 bytes each and a flag for those it saw twice, to
shards of some SHARD_ROWS hashes. A shard keeps two bitmaps of one filter, with 16 bits a hash of its own: positions that
some hash set and positions that two of them set. A text that occurs twice has all of its positions in the second bitmap,
so none is missed; a single one gets there with a chance of about 0.3 %, whatever the table's size, as no filter is global.

Pass two tests every row against a filter of the flagged hashes only, with 16 bits each (0.3 % once more): rows outside are
single and pass straight through, the others are grouped by SHA-256. That filter is broadcast up to MOST_BITS (32 MiB, 16 M
repeated hashes), counted first; beyond it the rows find the flagged hashes by a merge join.

Defined cases: null text counts as empty. Of equal texts the largest doc_id stays; a null doc_id is below all others and
stays where no other has the text. Rows that repeat both doc_id and text are one document: one row comes out, group_size
counts all of them; of rows that differ in other columns the least by all columns as JSON stays. An empty table gives an
empty result; extra columns are passed on by ``dedup`` and ignored by ``groups``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

HASHES = 4
SHARD_ROWS = 1 << 20
MOST_BITS = 1 << 28
PIECE_BITS = 1 << 20
#: Distinct hashes that a task holds at once.
PARTIAL_ROWS = 1 << 20


def bits_for(rows: int) -> int:
    """16 bits a hash or more, a power of two."""
    return max(1 << 13, 1 << int(16 * max(1, rows) - 1).bit_length())


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(rows, HASHES) positions by double hashing of 64-bit hashes; bits is a power of two."""
    h = hashes.astype(np.uint64)
    step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def add(seen: np.ndarray, twice: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    """seen and twice have one byte for 8 positions; a position counts once for each row."""
    pos = np.sort(positions(hashes, bits), axis=1)
    first = np.ones(pos.shape, bool)
    first[:, 1:] = pos[:, 1:] != pos[:, :-1]
    flat, counts = np.unique(pos[first], return_counts=True)
    byte, bit = flat >> 3, (1 << (flat & 7)).astype(np.uint8)
    again = (counts > 1) | (seen[byte] & bit != 0)
    np.bitwise_or.at(twice, byte[again], bit[again])
    np.bitwise_or.at(seen, byte, bit)


def flagged(twice: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    pos = positions(hashes, bits)
    return ((twice[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).all(axis=1)


def once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, again): a task's distinct hashes, in runs of PARTIAL_ROWS rows; a hot hash leaves a task once a run."""

    def run(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, times = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(times > 1)], names=["h", "again"])

    held, n = [], 0
    for b in batches:
        held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        n += b.num_rows
        if n >= PARTIAL_ROWS:
            yield run(held)
            held, n = [], 0
    if n:
        yield run(held)


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The flagged hashes of a shard, each once: both passes over the shard's own hashes."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not parts:
        return
    h, again = (np.concatenate(x) for x in zip(*parts, strict=True))
    h = h.astype(np.int64).view(np.uint64)
    bits = bits_for(len(h))
    seen, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
    add(seen, twice, h, bits)
    out = np.unique(h[again.astype(bool) | flagged(twice, h, bits)])
    for i in range(0, len(out), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 100_000].view(np.int64))], names=["h"])


def repeated_hashes(hashes: DataFrame, column: str = "h") -> DataFrame:
    """h: the distinct hashes that may occur twice, as a table in the shared folder."""
    spark = hashes.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-hashes.count() // SHARD_ROWS))
    own = hashes.select(F.col(column).alias("h")).mapInArrow(once_a_task, "h bigint, again boolean")
    return written(own.repartition(shards, F.shiftright("h", 20)).mapInArrow(repeated, "h bigint"), "repeated-hashes")


def filter_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """A plain filter of a table of hashes; what reaches the driver has bits / 8 bytes, in pieces that its tasks merged."""
    piece = min(bits, PIECE_BITS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(bits >> 3, np.uint8), 0
        for b in batches:
            flat = np.unique(positions(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            np.bitwise_or.at(seen, flat >> 3, (1 << (flat & 7)).astype(np.uint8))
            n += b.num_rows
        for i in range(bits // piece if n else 0):
            own = seen[i * piece >> 3 : (i + 1) * piece >> 3]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)])], names=["piece", "seen"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.frombuffer(zlib.decompress(x), np.uint8)
                held[i] = held[i] | own if i in held else own
        for i, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)])], names=["piece", "seen"])

    parts = hashes.mapInArrow(build, "piece int, seen binary")
    out = np.zeros(bits >> 3, np.uint8)
    for r in parts.repartition(min(bits // piece, 64), "piece").mapInArrow(merge, "piece int, seen binary").toLocalIterator():
        out[r["piece"] * piece >> 3 : (r["piece"] + 1) * piece >> 3] = np.frombuffer(zlib.decompress(r["seen"]), np.uint8)
    return out


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("h"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("sha"))


def marked(rows: DataFrame, some: DataFrame, h: Column) -> DataFrame:
    """rows with __maybe: is this hash among the flagged ones? some: repeated_hashes, counted here."""
    spark = rows.sparkSession
    bits = bits_for(some.count())
    if bits > MOST_BITS:
        some = some.select(F.col("h").alias("__h"), F.lit(True).alias("__maybe")).hint("merge")
        return rows.withColumn("__own", h).join(some, F.col("__own") == F.col("__h"), "left").withColumn("__maybe", F.coalesce("__maybe", F.lit(False))).drop("__own", "__h")
    shared = spark.sparkContext.broadcast(zlib.compress(filter_of(some, bits).tobytes(), 1))

    @F.pandas_udf("boolean")
    def maybe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for x in batches:
            yield pd.Series(flagged(seen, x.to_numpy(np.int64).view(np.uint64), bits))

    return rows.withColumn("__maybe", maybe(h))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, sha of every document. The texts are read once, into a table of hashes.

    The hot part is a group of copies: sizes and survivors come from partial aggregates by (sha, doc_id), then by sha;
    the join back is a plain sort-merge join, which adaptive execution splits where one key is hot.
    """
    rows = written(hashed(docs, key, text), "hashes")
    rows = marked(rows, repeated_hashes(rows), F.col("h"))
    single = rows.where(~F.col("__maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "sha")
    some = rows.where("__maybe").groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    some = written(some, "repeated")
    survivors = written(some.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "survivors")
    return single.unionByName(some.join(survivors, "sha").select("doc_id", "keep_id", "group_size", "sha"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose text a larger doc_id has too; rows that repeat doc_id and text become one.

    Rows that the filter doesn't flag keep their place; only flagged rows meet in a shuffle (always a merge join: the
    survivors grow with the corpus, so they are broadcast at no size).
    """
    columns = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    hashes = written(hashed(docs, key, text), "hashes")
    some = repeated_hashes(hashes)
    one = lambda sha, id_: F.concat(F.lower(F.hex(sha)), F.lit(":"), F.coalesce(id_.cast("string"), F.lit("")))
    keep = marked(hashes, some, F.col("h")).where("__maybe").groupBy("sha").agg(F.max("doc_id").alias("doc_id"))
    keep = written(keep.select(one(F.col("sha"), F.col("doc_id")).alias("__one")), "survivors")
    rows = marked(docs, some, F.xxhash64(body))
    straight = rows.where(~F.col("__maybe")).select(*columns)
    # one column, sha and doc_id together, for the join and for repeated rows: one shuffle, and no copy's hash is hot in it
    rest = rows.where("__maybe").withColumn("__one", one(F.unhex(F.sha2(body.cast("binary"), 256)), F.col(key)))
    rest = rest.join(keep.hint("merge"), "__one", "left_semi")
    others = [c for c in columns if c != text]
    least = rest.groupBy("__one").agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*others))).alias("__row"))
    return straight.unionByName(least.select("__row.*"))


def op2_rows(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


#: Rows that repeat doc_id and text are one document, as in ``groups``.
OP2_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS body, count(*) AS n FROM documents GROUP BY ALL)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(sum(n) OVER w AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)"""
