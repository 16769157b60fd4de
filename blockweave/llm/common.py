"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.session import scratch_path

#: Bytes of one block of a stated query set (benchmark items, query vectors) that is broadcast at a time.
BLOCK_BYTES = 32 * 1024 * 1024


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: a lineage cut that survives executors."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def query_blocks(rows: DataFrame, key: Column, size: Column, limit: int = BLOCK_BYTES) -> Iterator[DataFrame]:
    """Cut a stated query set into blocks of about ``limit`` bytes each, by a hash of its key.

    Every row is in one block. Sizes are summed by Spark; a block over the limit makes all blocks smaller
    until each fits or holds a single row.
    """
    sized = rows.select("*", F.xxhash64(key).alias("block_hash"), size.cast("bigint").alias("block_size"))
    total = sized.agg(F.sum("block_size")).first()[0] or 0
    blocks = max(1, -(-2 * total // limit)) if total > limit else 1
    while blocks > 1:
        group = F.pmod("block_hash", F.lit(blocks))
        over = sized.groupBy(group.alias("b")).agg(F.sum("block_size").alias("s"), F.countDistinct("block_hash").alias("n"))
        if over.where((F.col("s") > limit) & (F.col("n") > 1)).isEmpty():
            break
        blocks *= 2
    for b in range(blocks):
        part = sized.where(F.pmod("block_hash", F.lit(blocks)) == b) if blocks > 1 else sized
        yield part.drop("block_hash", "block_size")


def partitions_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def text_runs(texts: pa.Array, limit: int, each: int = 0) -> Iterator[slice]:
    """Runs of texts of about ``limit`` bytes, a row counting ``each`` bytes more; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) + each)
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield slice(start, end)
        start = end


def release_memory() -> None:
    """Give memory that a worker has freed back to the system, for the stages that reuse the worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass
