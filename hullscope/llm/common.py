"""What the corpus operators share: words, bounded batches of texts, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one slice of a batch holds at most, but for a single longer text.
SLICE_BYTES = 3_000_000

#: Bytes of a batch that crosses between the JVM and Python.
BATCH_BYTES = 8 << 20

#: A word is a run of bytes other than these six; ``bytes.split`` without arguments splits at exactly them.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the cluster's; a local session gets its own where none is set."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="hullscope-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there and lost executors cost no rework.

    The table stays until the application's owner clears the folder, as a result may be read lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hullscope/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def crc_remainder(key: object, modulus: int) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode()) % modulus


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts as UTF-8) of a batch, in runs of bounded size, so that what is made of a run stays bounded too."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_binary(texts.type) and not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    run: list[bytes | None] = []
    held = first = 0
    for i in range(len(texts)):
        x = texts[i].as_py()
        run.append(x)
        held += len(x or b"")
        if held >= most:
            yield first, run
            run, held, first = [], 0, i + 1
    if run:
        yield first, run


def bounded_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES between the JVM and Python, unless the session says otherwise than Spark's default of 64 MiB:
    long texts would fill a batch of 10,000 rows on both sides, off the heap, in every task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64m", "64MB"):
        spark.conf.set(name, str(BATCH_BYTES))


def map_texts(df: DataFrame, keys: list[Column], fn: Callable[[list[bytes | None]], list], fields: str, text: str = "text") -> DataFrame:
    """One row per row of df: the keys, then what fn makes of the texts (one sequence of values for each field).

    Only the keys and the text leave the JVM, so extra columns of df can't clash with anything.
    """
    bounded_batches(df.sparkSession)
    narrow = df.select(*keys, F.col(text).alias("__text"))
    key_schema = narrow.drop("__text").schema
    out = narrow.drop("__text").limit(0).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    made = _parse_datatype_string(fields)
    out = StructType(key_schema.fields + made.fields)
    types = [f.type for f in to_arrow_schema(made)]
    names = [f.name for f in made.fields]
    n_keys = len(key_schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch, "__text"):
                cols = fn(texts)
                own = [batch.column(i).slice(first, len(texts)) for i in range(n_keys)]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t, from_pandas=False) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *arrays], names=[*(f.name for f in key_schema.fields), *names])

    return narrow.mapInArrow(run, out)


def gather_texts(df: DataFrame, columns: list[Column], fn: Callable[[Iterator[tuple[pa.RecordBatch, int, list[bytes | None]]]], Iterator[pa.RecordBatch]], schema: str, text: str = "text") -> DataFrame:
    """Aggregates inside each task: fn reads the task's (batch, first row, texts) and yields batches of partial results."""
    bounded_batches(df.sparkSession)
    narrow = df.select(*columns, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn((batch, first, texts) for batch in batches for first, texts in slices(batch, "__text"))

    return narrow.mapInArrow(run, schema)


def sums_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values (1 or 2 dimensions) by owner in 0..n-1."""
    if values.ndim == 1:
        return np.bincount(owner, weights=values, minlength=n)
    return np.stack([np.bincount(owner, weights=values[:, j], minlength=n) for j in range(values.shape[1])], axis=1)
