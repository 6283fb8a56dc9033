"""Mixing sources to target weights by systematic sampling.

Each source has a target in words; a document's expected copies are target / size of its source. Within a source the
documents stand in one order (by size, then by a hash of the key): the expected copies are prefix-summed along it, one
random offset is added for the source, and a document is emitted once for each integer boundary that its stretch of the
sum crosses. As neighbours have about the same size, the words taken stay within about one document of the target.

The prefix sum is a count, as all documents of a source expect the same. Rows are dealt by range of (source, size, hash,
row) - the row's number makes every place unique, so a hot source, a group of copies or a repeated key is split like any
other stretch -, numbered inside their part, and shifted by the counts of the source in the parts before: a table with a
row for each source of each part, joined by shuffle unless it is small.

Targets come from a table with a row a source. Its weights follow from the same kind of numbering; the level of water is
found by sharing what capped sources leave until no more source is capped, each round one aggregate. No task sees all
sources, and no source table is broadcast unless its counted size allows.

Defined cases: null text has size 0; sources sort by code point with null last; a source of size 0 has target 0; rows
that repeat a key are ranked side by side and each is drawn on its own; an empty table gives an empty result; extra
columns are passed on by ``mixed`` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, written

BROADCAST_ROWS = 100_000
SEED = "mix-1"

#: DuckDB runs this, for what `targets` does in rounds: sources(source, size) to targets. A source is capped if its cap for a unit of weight
#: is below the level of water. Caps are taken in order of that ratio; the level after k of them comes from integer sums,
#: rises while capped sources leave words for the others, and is highest at the first source that stays below its cap.
TARGETS_SQL = """
ranked AS (SELECT source, size, CASE (row_number() OVER (ORDER BY CASE WHEN source IS NULL THEN 1 ELSE 0 END, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM {sources}),
filled AS (SELECT source, size, w, sum(size) OVER () AS total, sum(w) OVER () AS all_w,
  coalesce(sum(2 * size) OVER (ORDER BY 2.0E0 * size / w, CASE WHEN source IS NULL THEN 1 ELSE 0 END, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  coalesce(sum(w) OVER (ORDER BY 2.0E0 * size / w, CASE WHEN source IS NULL THEN 1 ELSE 0 END, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_w FROM ranked),
level AS (SELECT max(CAST(3 * total - 2 * capped AS DOUBLE) / CAST(2 * (all_w - capped_w) AS DOUBLE)) AS per_w FROM filled WHERE 2.0E0 * size / w >= CAST(3 * total - 2 * capped AS DOUBLE) / CAST(2 * (all_w - capped_w) AS DOUBLE)),
targets AS (SELECT source, CAST(size AS BIGINT) AS source_size, coalesce(least(2.0E0 * size, (SELECT per_w FROM level) * w), 2.0E0 * size) AS target FROM ranked)
"""


def sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", row: str | None = None) -> DataFrame:
    keys = [F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), *([F.col(row).alias("row")] if row else [])]
    rows = map_texts(docs, keys, lambda texts: [[len((b or b"").split()) for b in texts]], "size bigint", text)
    if not row:
        rows = rows.withColumn("row", F.monotonically_increasing_id())
    return rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))


def same_source(a: str, b: str):
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def checked(few: DataFrame) -> DataFrame:
    """few, to be broadcast if its rows are few, and to be merged otherwise."""
    return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few.hint("merge")


def numbered(rows: DataFrame, by: str | None, order: list) -> DataFrame:
    """rows with pos: 0, 1, 2... in the given order, within each value of ``by`` (which the order starts with)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    dealt = written(dealt, "numbered")
    own = [by] if by else []
    counts = dealt.groupBy(*own, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy(*own, *([] if by else [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = written(counts.withColumn("__skip", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), "starts")
    if by:
        starts = starts.withColumnRenamed(by, "__by")
        on = F.col(by).eqNullSafe(F.col("__by")) & (F.col("p.__part") == F.col("s.__part"))
    else:
        on = F.col("p.__part") == F.col("s.__part")
    found = dealt.alias("p").join(checked(starts).alias("s"), on)
    return found.select(*(f"p.{c}" for c in rows.columns), (F.col("__id") - F.col("__first") + F.col("__skip")).alias("pos"))


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, target of rows with source and size."""
    sums = written(rows.groupBy("source").agg(F.sum("size").alias("size")), "source-sizes")
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.when(F.col("pos") % 3 == 0, 3).when(F.col("pos") % 3 == 1, 1).otherwise(2)
    own = written(numbered(sums, None, order).select("source", "size", weight.alias("w")), "source-weights")
    cap = F.lit(2.0) * F.col("size") / F.col("w")
    total = own.agg(F.sum("size").alias("size"), F.sum("w").alias("w")).first()
    level, capped = None, (-1, -1)
    while total["w"]:  # each round caps a source more, and a share of all in practice
        gone = own.where(cap < F.lit(level)).agg(F.coalesce(F.sum(2 * F.col("size")), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first() if level is not None else {"size": 0, "w": 0}
        if (gone["size"], gone["w"]) == capped or gone["w"] == total["w"]:
            break
        capped = (gone["size"], gone["w"])
        level = float(3 * total["size"] - 2 * capped[0]) / float(2 * (total["w"] - capped[1]))
    most = F.lit(2.0) * F.col("size")
    return own.select("source", F.col("size").cast("bigint").alias("source_size"), (most if level is None else F.least(most, F.lit(level) * F.col("w"))).alias("target"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows with pos: 0, 1, 2... within the source by (size, h, doc_id)."""
    return numbered(rows, "source", [F.col("source"), F.col("size"), F.col("h"), F.col("doc_id"), F.col("row")])


def offset() -> str:
    """SQL of the source's offset in [0, 1), the same in Spark and DuckDB."""
    return f"md5(concat('{SEED}:', coalesce(source, '')))"


def drawn(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0, 1 or 2) and row: a number of the row, or the column named."""
    rows = written(sizes(docs, key, source, text, row), "sizes")
    goal = checked(written(targets(rows), "targets"))
    u = F.conv(F.substring(F.expr(offset()), 1, 7), 16, 10).cast("double") / F.lit(float(16**7))
    rows = ranked(rows).alias("r").join(goal.alias("t"), same_source("r", "t")).select("r.*", "t.source_size", "t.target").withColumn("u", u)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    upto = lambda pos: F.floor(F.col("u") + pos.cast("double") * rate)
    copies = F.least(F.lit(2), F.greatest(F.lit(0), upto(F.col("pos") + 1) - upto(F.col("pos"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), "row")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with each row as often as it is drawn. The rows are numbered in a table of their own, so that rows that repeat
    a key, or all columns, get their own copies."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    out = drawn(rows, key, source, text, "__row").where("copies > 0").select(F.col("row").alias("__row"), F.col("copies").alias("__copies"))
    # what is drawn grows with the corpus: never broadcast, so the plan is one and the same at every size
    rows = rows.join(written(out, "drawn").hint("merge"), "__row")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def op9_rows(docs: DataFrame) -> DataFrame:
    return drawn(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


OP9_SQL = rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, sum(size) AS size FROM d GROUP BY source), {TARGETS_SQL.format(sources="s")},
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id) - 1 AS pos, CAST(CAST('0x' || substr({offset()}, 1, 7) AS BIGINT) AS DOUBLE) / 268435456.0E0 AS u FROM d),
t AS (SELECT doc_id, size, source_size, target, pos, u, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0E0 END AS rate FROM r JOIN targets ON r.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, CAST(size * least(2, greatest(0, floor(u + CAST(pos + 1 AS DOUBLE) * rate) - floor(u + CAST(pos AS DOUBLE) * rate))) AS BIGINT) AS taken FROM t"""
