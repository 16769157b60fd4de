"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Every row gets its source partition and a number of its own; only these, ``doc_id``, size and checksum go on, written once.
2. From the row counts of the partitions the matrix "rows of partition p for shard k" is drawn: it has the
   law of a uniform random assignment with fixed shard sizes (multivariate hypergeometric). It is drawn
   on the driver from one count per partition; no row is seen there.
3. Rows are permuted inside their partition (row number by a seeded hash) and the matrix cuts that order
   into shards.
4. Rows are exchanged and permuted again: a second seeded hash orders each shard. Its top bits deal a shard
   over buckets, so no task holds a whole shard; a row's slot is the rows of earlier buckets plus its place.

Law: ``rows``, shard sizes differ by one at most. Everything that touches rows is DataFrame functions.

Defined results: a null text has size 1 and checksum 0, a null id is kept as null. Repeated rows are permuted by
their own numbers, so copies spread over all shards and buckets. An empty table gives none.
Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockweave.llm.common import partitions_for, written

SHARDS = 8
SEED = 20_240_601
#: Rows of a bucket of the second permutation, on average.
BUCKET_ROWS = 4096
#: Probabilities this far below the mode are left out of an inversion; a double cannot add them either.
NEGLIGIBLE = 1e-18


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` of good + bad without replacement, by inversion around the mode.

    Ratios of neighbouring probabilities are multiplied outwards until they are negligible, so the work
    follows the standard deviation and the numbers may be of any size.
    """
    least, most = max(0, drawn - bad), min(good, drawn)
    if least == most:
        return least
    mode = min(most, max(least, (drawn + 1) * (good + 1) // (good + bad + 2)))
    spread = (drawn * good * bad * (good + bad - drawn)) ** 0.5 / (good + bad) ** 1.5
    reach = int(12 * spread) + 40

    def outward(first: int, last: int, up: bool) -> np.ndarray:
        x = np.arange(first, last, dtype=float) if up else np.arange(first, last, -1, dtype=float)
        ratio = (good - x) * (drawn - x) / ((x + 1) * (bad - drawn + x + 1))
        if not up:
            ratio = x * (bad - drawn + x) / ((good - x + 1) * (drawn - x + 1))
        p = np.cumprod(ratio)
        return p[: int((p > NEGLIGIBLE).sum())]

    above = outward(mode, min(most, mode + reach), True)
    below = outward(mode, max(least, mode - reach), False)
    weights = np.concatenate([below[::-1], [1.0], above])
    total = np.cumsum(weights)
    return mode - len(below) + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of each partition for each shard, with these row sums and column sums."""
    if sum(counts) != sum(sizes):
        raise ValueError("partition counts and shard sizes must have the same sum")
    rng, left = np.random.default_rng(seed), list(sizes)
    matrix = []
    for n in counts:
        row, rest = [], sum(left)
        for have in left:
            rest -= have
            take = hypergeometric(rng, have, rest, n)
            row.append(take)
            n -= take
        left = [have - take for have, take in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def shuffle_into_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; ``grown_shard`` is null."""
    if shards < 1:
        raise ValueError("shards must be positive")
    spark, text = docs.sparkSession, F.col(text_col)
    rows = written(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            # the row's own number, fixed by the write: copies of a row go their own ways
            F.monotonically_increasing_id().alias("row_no"),
            F.spark_partition_id().alias("source"),
        ),
        "shard-rows",
    )
    counts = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()]
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], shard_sizes(total, shards), seed)
    ends = [(p, [int(x) for x in np.cumsum(row)]) for (p, _), row in zip(counts, matrix, strict=True)]
    matrix_rows = spark.createDataFrame(ends, "source int, ends array<bigint>")

    # Local permutation; the matrix cuts it into shards. Row number and join share one exchange by source.
    local = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "row_no"), "row_no")
    dealt = rows.withColumn("place", F.row_number().over(local) - 1).join(matrix_rows, "source")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))))

    # Exchange and second permutation, over buckets of a shard.
    buckets = partitions_for(partitions_for(total, shards), bucket_rows)
    second = F.xxhash64(F.lit(seed + 1), "row_no")
    dealt = dealt.select(
        "doc_id", "size", "text_crc32", "row_no", "shard", second.alias("key"),
        F.floor(F.shiftrightunsigned(second, 32) * F.lit(buckets) / F.lit(2.0**32)).cast("int").alias("bucket"),
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "row_no")
    placed = written(dealt.withColumn("inside", F.row_number().over(inside)), "shard-placed")
    filled = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = filled.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(bases, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("inside") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
