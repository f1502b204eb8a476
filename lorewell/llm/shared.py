"""Shared folders, input sizes and Arrow batches: what every operator here needs."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell.llm.tokens import mix

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``; a machine's own only in local mode where that is unset (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "lorewell-checkpoints")
        spark.sparkContext.setCheckpointDir(base)
        base = "file://" + base
    return f"{base.rstrip('/')}/lorewell-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go as it ends; else they stay until the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, so later plans never recompute it; its shuffle files are freed."""
    path, conf = shared_dir(df.sparkSession), df.sparkSession.conf
    before = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(FREED) if before is None else conf.set(FREED, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def done(*frames: DataFrame) -> None:
    """Removes what ``cut`` wrote of these; no plan that is still to run may read them."""
    for df in frames:
        jvm, path = df.sparkSession._jvm, df._cut_path
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the scanned bytes: file sizes, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shard_count(df: DataFrame, shard_bytes: int = 8 << 20, least: int = 16) -> int:
    """Hash shards so that each holds the same share of any input; in proportion to the scanned bytes."""
    size = input_bytes(df)
    if size > 1 << 60:  # the optimizer's way to say that it doesn't know
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, min(1 << 20, -(-size // shard_bytes)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows of a string column and the rows' offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = 3 << 20):
    """Ranges of rows of about ``limit`` bytes; a longer row has a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_chunks(batch: pa.RecordBatch, name: str = "text", limit: int = 1 << 20, trimmed: bool = True):
    """(first row, end row, bytes, offsets) of pieces of a batch. Steps that need little memory don't have it ``trimmed``, which costs time."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(name)))
    for lo, hi in row_chunks(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
    if trimmed:
        trim()


def trim() -> None:
    """Gives freed memory back to the system: workers live on for later stages, and what they keep counts beside the heap."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def reuse_freed() -> None:
    """Keeps up to 64 MB of freed memory for the next arrays, in steps that would ask the system for the same pages again and again; ``trim`` gives it back."""
    if _LIBC is not None:
        _LIBC.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
        _LIBC.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that stay small for long texts: a batch ends at either bound. The session keeps these settings, as results are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def _filter_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    return run


def id_filter(ids: DataFrame, most: int = 1 << 25) -> np.ndarray:
    """Bits (a power of two, at most ``most``: 4 MB) by the hashes of the ids in the first column. More ids pass more others, never fewer."""
    bits = 1 << min(most.bit_length() - 1, max(10, int(16 * ids.count()).bit_length()))
    words = ids.select(F.col(ids.columns[0]).cast("long")).mapInArrow(_filter_words(bits), "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def in_filter(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = mix(np.ascontiguousarray(ids).view(np.uint64)) & np.uint64((len(bits) << 6) - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
