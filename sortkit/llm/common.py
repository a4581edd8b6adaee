"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortkit.plans.lineage import cut, ensure_checkpoint_dir

__all__ = ["CHUNK_BYTES", "SLICE_BYTES", "chunked", "crc_mod", "cut", "ensure_checkpoint_dir", "pieces", "read_table", "release", "stash", "text_slices", "tidy", "tidy_batches", "tidy_pair", "total_bytes"]

#: Bytes of text handled by one Python call; a chunk's arrays take about 20 times that.
CHUNK_BYTES = 6_000_000
#: Bytes of text of a slice of an Arrow batch, unless one text is longer.
SLICE_BYTES = 1_500_000


def text_slices(batch: pa.RecordBatch, column: int = 0, most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch of about ``most`` bytes of a text column and so many rows; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 16)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        till = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
        yield batch.slice(at, till - at)
        at = till


def release() -> None:
    """Give freed memory back to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy_batches(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` for ``mapInArrow``, which gives memory back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def tidy(work: Callable[[pa.Table], pa.Table]) -> Callable:
    """``work`` for a grouped ``applyInArrow``, which gives memory back after each group."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            release()

    return run


def tidy_pair(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable:
    """``work`` for a cogrouped ``applyInArrow``, which gives memory back after each group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(left, right)
        finally:
            release()

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str | Column, n: int) -> Column:
    """``crc32(id as text) mod n``; null ids give null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % n


def total_bytes(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text_col)))).first()
    return int(r[0]), int(r[1] or 0)


def pieces(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def chunked(docs: DataFrame, id_col: str, text_col: str, n_chunks: int, *more: Column) -> DataFrame:
    """``(chunk, doc_id, text, <more>)``: rows dealt to chunks by a hash of id and text, so that a
    repeated id does not gather in one chunk; text as bytes, null text empty."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_chunks)).cast("int").alias("chunk"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("text"),
        *more,
    )


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back."""
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
