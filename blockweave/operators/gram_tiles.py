"""FᵀF of a tall factor of large rank as a table of symmetric tiles, and its product with the factor by join.

A task adds up the tiles of the upper half, a stripe of them at a time so that it holds a bounded part; tiles are summed
by key, each on its own; the lower half is the upper one turned. Nothing of the size rank x rank comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.functions import arrow
from blockweave.functions.columns import zero_or_ratio
from blockweave.operators import block
from blockweave.operators.block import BlockMatrix, Grid
from blockweave.operators.numbering import numbered
from blockweave.operators.product import HELD_BYTES, added, block_rows
from blockweave.session import MAX_BLOCK_CELLS

#: Rows and columns of a tile; rows of a group of factor rows.
TILE, GROUP = 512, 512


def stripes(rank: int, tile: int, held: int = HELD_BYTES) -> list[tuple[int, int]]:
    """(first, end) columns of runs of tile rows whose upper part is at most ``held`` bytes, or one tile row."""
    found, start = [], 0
    while start < rank:
        end = min(rank, start + tile)
        while end < rank and 8 * (min(rank, end + tile) - start) * (rank - start) <= held:
            end = min(rank, end + tile)
        found.append((start, end))
        start = end
    return found


def _partial(rank: int, tile: int, start: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((end - start, rank - start))
        for batch in batches:
            rows = arrow.to_matrix(batch.column(0))
            if len(rows):
                if rows.shape[1] != rank:
                    raise ValueError(f"expected factor rows of {rank} values but got {rows.shape[1]}")
                total += rows[:, start:end].T @ rows[:, start:]
        tiles = {}
        for p in range(start, end, tile):
            for q in range(p, rank, tile):
                tiles[p // tile, q // tile] = total[p - start : min(p + tile, end) - start, q - start : q - start + tile]
        yield from block_rows(tiles)

    return run


def _both_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p, q, nr, nc, data in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
            upper = data.values.to_numpy().reshape(nr, nc, order="F")
            yield from block_rows({(p, q): upper} if p == q else {(p, q): upper, (q, p): upper.T})


def gram_blocks(factor: DataFrame, rank: int, tile: int = TILE) -> BlockMatrix:
    """FᵀF of rows ``(id, f)`` as a rank x rank block matrix; empty without rows."""
    grid = Grid(rank, rank, tile, tile)
    rows, partial = factor.select("f"), None
    for start, end in stripes(rank, tile):
        one = rows.mapInArrow(_partial(rank, tile, start, end), block.SCHEMA)
        partial = one if partial is None else partial.unionAll(one)
    return BlockMatrix(added(partial).mapInArrow(_both_halves, block.SCHEMA), grid)


def apply_gram(factor: DataFrame, gram: BlockMatrix) -> DataFrame:
    """F·G: ``(id, f)``. Groups of factor rows meet the tiles by join; rows need ids of their own."""
    rank, tile = gram.grid.rows, gram.grid.block_rows
    group = max(1, min(GROUP, MAX_BLOCK_CELLS // max(rank, 1)))
    placed = numbered(factor.select("id", "f"), "id", name="place")  # written
    row = F.struct("place", "id", "f")
    groups = placed.groupBy(F.expr(f"cast(place div {group} as int)").alias("bi")).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, lists in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = arrow.to_matrix(lists.values)
                yield from block_rows({(bi, n): values[:, n * tile : (n + 1) * tile] for n in range(-(-rank // tile))})

    left = groups.select("bi", F.col("rows.f").alias("f")).mapInArrow(split, block.SCHEMA)
    count = placed.count()
    product = block.multiply(BlockMatrix(left, Grid(count, rank, group, tile)), gram).blocks
    parts = product.groupBy("bi").agg(F.array_sort(F.collect_list(F.struct("bj", "nr", "nc", "data"))).alias("parts"))
    ids = groups.select("bi", F.col("rows.id").alias("ids"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, parts in zip(batch.column("ids"), batch.column("parts"), strict=True):
                cells = [np.array(p["data"]).reshape(p["nr"], p["nc"], order="F") for p in parts.as_py()]
                yield pa.RecordBatch.from_arrays([ids.values, arrow.to_lists(np.concatenate(cells, axis=1))], ["id", "f"])

    return ids.join(parts, "bi").mapInArrow(joined, "id bigint, f array<double>")


def update(factor: DataFrame, projected: DataFrame, gram: BlockMatrix) -> DataFrame:
    """F ∘ X ⊘ (F·G), as ``factor.update`` but with the Gram matrix as a table."""
    x, y = projected.select("id", F.col("f").alias("x")), apply_gram(factor, gram).select("id", F.col("f").alias("y"))
    zeros = F.array_repeat(F.lit(0.0), gram.grid.rows)
    met = factor.join(x, "id", "left").join(y, "id").select("id", F.arrays_zip("f", F.coalesce("x", zeros).alias("x"), "y").alias("c"))
    return met.select("id", F.transform("c", lambda c: zero_or_ratio(c["f"] * c["x"], c["y"])).alias("f"))
