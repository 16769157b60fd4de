"""Mixing sources to target weights by Pfair scheduling of blocks.

A source's documents are put in a seeded order and cut into blocks of ``block_bytes``. Weights become whole
numbers n adding up to D = ``GRAIN``, so fine that their rounding is far below a block. Block j (from 0) of a
source is released at floor(j D / n) and due at ceil((j + 1) D / n); each slot goes to the released block that is
due first. On one line of slots with all weights adding up to one this meets every deadline, so after any number
of slots of a phase a source is less than one block off its share, however many slots there are. What follows
depends only on how many blocks of each source are placed, so the slots are cut into frames: the driver walks
over them once (blocks, not rows) and keeps these numbers at each frame's start; tasks lay the frames out.

When a source runs out, the phase ends with its frame and the other weights are scaled up (a phase for each
source at most). No row is dropped or repeated; slots of blocks that a source no longer has stay empty.

Running sums over a source are taken inside hash buckets and over the sums of buckets, so a source that
holds most rows is spread like any other. Sources are a stated set (weights are given by source): their
totals, one row each, go through the driver.

Defined results: a null source is a source of its own; null texts have no bytes; documents without bytes
still get a place. Repeated rows have places of their own, like other rows. Without weights, they are the
square roots of the sources' bytes. An empty table gives no rows. Only the named columns are read by ``schedule``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockweave.llm.common import partitions_for, written

BLOCK_BYTES, SEED = 256 * 1024, 7
#: Slots of a frame, or four for each source if that is more.
FRAME = 1024
#: Sum of the whole weights: after 2^40 blocks a source is 1/256 block off by their rounding.
GRAIN = 2**48
BUCKET_ROWS = 1024
#: Exponent of a source's bytes in its weight where none is given.
TEMPER = 0.5


def whole_weights(weights: list[float], frame: int) -> list[int]:
    """Shares of a frame in whole slots, at least one each, by largest remainder."""
    if any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    if len(weights) > frame:
        raise ValueError("a frame needs a slot for each source")
    total = sum(weights)
    exact = [w / total * frame for w in weights]
    counts = [max(1, int(x)) for x in exact]
    order = sorted(range(len(exact)), key=lambda s: counts[s] - exact[s])
    k = 0
    while sum(counts) < frame:
        counts[order[k % len(order)]] += 1
        k += 1
    while sum(counts) > frame:
        most = max(range(len(counts)), key=lambda s: (counts[s] > 1, counts[s] - exact[s]))
        counts[most] -= 1
    return counts


def frame_schedule(counts: list[int], frame: int, done: list[int] | None = None, at: int = 0) -> list[tuple[int, int]]:
    """(source, block) of the slots from ``at`` on: earliest deadline first among released blocks.

    ``counts`` are whole weights, ``done`` the blocks of each source in the slots before.
    """
    total = sum(counts)
    releases = [(j * total // counts[s], s, j) for s, j in enumerate(done or [0] * len(counts))]
    heapq.heapify(releases)
    ready: list[tuple[int, int, int]] = []
    slots = []
    for t in range(at, at + frame):
        while releases and releases[0][0] <= t:
            _, s, j = heapq.heappop(releases)
            heapq.heappush(ready, (-(-(j + 1) * total // counts[s]), s, j))
        due, s, j = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        slots.append((s, j))
        heapq.heappush(releases, ((j + 1) * total // counts[s], s, j + 1))
    return slots


def phases(blocks: list[int], weights: list[float], frame: int) -> list[dict]:
    """Each frame: its sources, their slots in it and first blocks; its first slot; the whole weights of its phase,
    the blocks of the phase before the frame, and the phase's first slot."""
    left, first, start, out = list(blocks), [0] * len(blocks), 0, []
    while any(left):
        active = [s for s, n in enumerate(left) if n]
        whole = whole_weights([weights[s] for s in active], GRAIN)
        done, origin = [0] * len(active), start
        while all(left[s] for s in active):
            counts = [0] * len(active)
            for k, _ in frame_schedule(whole, frame, done, start - origin):
                counts[k] += 1
            out.append({
                "sources": active, "counts": counts, "first": [first[s] for s in active], "start": start, "frames": 1,
                "weights": whole, "done": list(done), "origin": origin,
            })
            for k, s in enumerate(active):
                take = min(left[s], counts[k])
                left[s], first[s], done[k] = left[s] - take, first[s] + take, done[k] + counts[k]
            start += frame
    return out


WINDOWS = "source_no int, block_no bigint, release bigint, deadline bigint, slot bigint"


def _laid_out(frame: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sources, weights, first, done, start, origin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sum(weights)
                rows = [
                    (sources[k], first[k] + j - done[k], origin + j * total // weights[k], origin - (-(j + 1) * total // weights[k]), slot)
                    for slot, (k, j) in enumerate(frame_schedule(weights, frame, done, start - origin), start)
                ]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                names = ["source_no", "block_no", "release", "deadline", "slot"]
                yield pa.RecordBatch.from_arrays([columns[0].cast(pa.int32()), *columns[1:]], names=names)

    return run


def in_blocks(
    docs: DataFrame, block_bytes: int, seed: int, id_col: str, text_col: str, source_col: str, row_col: str | None = None
) -> DataFrame:
    """``row_no, doc_id, source, size, at, block``: the seeded order of each source and its blocks; written.

    A row is known by ``row_col``, a number of its own, or else by one that it gets here.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    rows = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_no"), F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"), size.alias("size"),
    )
    rows = written(rows, "mix-rows").withColumn("key", F.xxhash64(F.lit(seed), "row_no"))
    buckets = partitions_for(rows.count(), BUCKET_ROWS)
    bucket = F.floor(F.shiftrightunsigned("key", 32) * F.lit(buckets) / F.lit(2.0**32)).cast("int")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "row_no")
    summed = rows.withColumn("bucket", bucket).withColumn(
        "inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    totals = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("source").alias("base_source"), F.col("bucket").alias("base_bucket"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"),
    )
    same = F.col("source").eqNullSafe(F.col("base_source")) & (F.col("bucket") == F.col("base_bucket"))
    at = F.col("base") + F.col("inside")
    placed = summed.join(bases, same).select("row_no", "doc_id", "source", "size", at.alias("at"), "key")
    return written(placed.withColumn("block", F.floor(F.col("at") / F.lit(block_bytes))), "mix-blocks")


def schedule(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, seed: int = SEED,
    frame: int = FRAME, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None,
) -> DataFrame:
    """``row_no, doc_id, source, size, block, release, deadline, slot, place`` of every document.

    Documents sorted by (slot, place) are the mixture; ``release`` and ``deadline`` bound the slot of the block.
    """
    if block_bytes < 1:
        raise ValueError("block_bytes must be positive")
    spark = docs.sparkSession
    placed = in_blocks(docs, block_bytes, seed, id_col, text_col, source_col, row_col)
    totals = placed.groupBy("source").agg(F.sum("size").alias("bytes"), (F.max("block") + 1).alias("blocks")).collect()
    totals.sort(key=lambda r: (r["source"] is not None, r["source"] or ""))
    names = [r["source"] for r in totals]
    missing = [n for n in names if weights is not None and n not in weights]
    if missing:
        raise ValueError(f"no weight for sources {missing[:5]}")
    shares = [weights[n] if weights is not None else max(1, r["bytes"]) ** TEMPER for n, r in zip(names, totals, strict=True)]
    frame = max(frame, 4 * len(names))
    plan = phases([r["blocks"] for r in totals], shares, frame)

    source_rows = spark.createDataFrame([(n, s) for s, n in enumerate(names)], "block_source string, source_no int")
    starts = spark.createDataFrame(
        [(p["sources"], p["weights"], p["first"], p["done"], p["start"], p["origin"]) for p in plan],
        "sources array<int>, weights array<bigint>, first array<bigint>, done array<bigint>, start bigint, origin bigint",
    )
    windows = starts.mapInArrow(_laid_out(frame), WINDOWS).join(F.broadcast(source_rows), "source_no").drop("source_no")
    same = F.col("source").eqNullSafe(F.col("block_source")) & (F.col("block") == F.col("block_no"))
    return placed.join(windows, same).select(
        "row_no", "doc_id", "source", "size", "block", "release", "deadline", "slot", F.col("at").alias("place"), "key"
    )


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, **names: str) -> DataFrame:
    """``docs`` with all rows and columns in the order of the mixture; written files keep it by number."""
    # whole rows in one column, so that no name can clash; written, so that a row keeps its number
    numbered = written(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("mix_row")), "mix-docs")
    columns = {c: names.get(f"{c}_col", default) for c, default in (("id", "doc_id"), ("text", "text"), ("source", "source"))}
    narrow = numbered.select(*[F.col("doc")[name].alias(f"mix_{c}") for c, name in columns.items()], "mix_row")
    slots = schedule(
        narrow, weights, block_bytes, id_col="mix_id", text_col="mix_text", source_col="mix_source", row_col="mix_row"
    ).select(F.col("row_no").alias("mix_row"), "slot", "place", "key")
    order = ["slot", "place", "key", "mix_row"]
    ordered = numbered.join(slots, "mix_row").repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("doc.*")
