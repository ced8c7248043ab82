"""Shared helpers: input tables, the shared folder, materialised intermediates and Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes in one Arrow batch. Texts run to hundreds of KB, so the default of 10,000 rows would need too much worker
#: memory; of very long ones a batch holds as many as fit, and one at least.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; a smaller number of rows in the session's settings stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        pass


_LOCAL: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names. Where it is unset, a local master gets a temporary folder
    and any other an error, as its executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="quillstream-"))
        base = _LOCAL[0]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: it survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slot_bits(slots: DataFrame, n: int) -> np.ndarray:
    """Bits of the slots (a column `slot`, 0 to n - 1) that occur, packed from the lowest: n / 8 bytes, whatever the rows."""
    out = np.zeros((max(1, n >> 15), 4096), np.uint8)
    at = F.col("slot").cast("long") + 1
    dealt = slots.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).repartition(partitions(slots.sparkSession), "b")
    for r in dealt.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect():  # no bitmaps in the shuffle
        out[r.b - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def has_bit(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def rows_in(df: DataFrame, hash_col: str, bits: np.ndarray, on: bool = True) -> DataFrame:
    """The rows whose hash (a long) falls in a marked slot, by its lowest bits; or, without `on`, all the others."""
    at, mask = df.columns.index(hash_col), bits.size * 8 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(bits, np.asarray(batch.column(at)) & mask) == on))

    return map_batches(df, run, df.schema)


def slots_of(df: DataFrame, hash_col: str, n: int) -> np.ndarray:
    """The marked slots, of n, for rows_in()."""
    return slot_bits(df.select(F.col(hash_col).bitwiseAND(F.lit(n - 1)).alias("slot")), n)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _give_back() -> None:
    """Return freed memory to the machine: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def pack(df: DataFrame, *keep: str) -> DataFrame:
    """All columns as one struct `row`, beside the expressions in keep: names of the input cannot clash with ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *keep)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of a string or binary array; null is empty. No copy of the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    start, end = off[:-1].copy(), off[1:].copy()
    if column.null_count:
        dead = np.asarray(column.is_null())
        end[dead] = start[dead]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), start, end


def blocks(start: np.ndarray, end: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `size` bytes together: (first, last + 1). A longer text stands alone."""
    i, n = 0, len(start)
    total = np.concatenate([[0], np.cumsum(end - start)])
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j
