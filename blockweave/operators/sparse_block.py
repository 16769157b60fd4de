"""Sparse matrices in block form: ``(bi, bj, nr, nc, starts, places, data)`` beside the same kind of grid.

A block is stored by compressed columns: ``starts`` has one number a column and the end, ``places`` are the rows of
the stored cells, ``data`` their values. A block or cell that is not there is zero. Products with dense and sparse
matrices are those of ``block.multiply``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.functions import arrow
from blockweave.operators import block, product
from blockweave.operators.block import BlockMatrix, Grid

SCHEMA = "bi int, bj int, nr int, nc int, starts array<int>, places array<int>, data array<double>"


def is_sparse(matrix: BlockMatrix) -> bool:
    return "starts" in matrix.blocks.columns


def _integer_lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))


def _rows(made: list[tuple]) -> pa.RecordBatch:
    keys = [pa.array([m[c] for m in made], pa.int32()) for c in range(4)]
    cells = [_integer_lists([m[4] for m in made]), _integer_lists([m[5] for m in made]), arrow.vector_rows([m[6] for m in made])]
    return pa.RecordBatch.from_arrays([*keys, *cells], ["bi", "bj", "nr", "nc", "starts", "places", "data"])


def _pieces(blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Blocks (bi, bj, nr, nc, starts, places, values) as rows, handed on by size and not by number."""
    made, size = [], 0
    for *key, starts, places, values in blocks:
        made.append((*key, starts.astype(np.int32), places.astype(np.int32), values))
        size += sum(cells.nbytes for cells in made[-1][4:])
        if size > product.PIECE_BYTES:
            yield _rows(made)
            made, size = [], 0
    if made:
        yield _rows(made)


def _compressed(pos: np.ndarray, values: np.ndarray, nr: int, nc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells at ``pos`` (column after column) by columns; repeated places are added up."""
    order = np.argsort(pos, kind="stable")
    pos, values = pos[order], values[order]
    first = np.flatnonzero(np.diff(pos, prepend=-1))
    pos, values = pos[first], np.add.reduceat(values, first) if len(first) else values
    return np.searchsorted(pos, np.arange(nc + 1) * nr), pos % nr, values


def to_sparse_blocks(
    entries: DataFrame, block_rows: int, block_cols: int, rows: int | None = None, cols: int | None = None,
    unique: bool = False, stored: int | None = None,
) -> BlockMatrix:
    """Entries to sparse blocks; repeated cells are added up, explicit zeros stay.

    Nothing the size of a dense block is made. ``stored``, the number of entries if it is known, lets a product
    choose its layout by what the blocks really hold.
    """
    grid = block.grid_of(entries, block_rows, block_cols, rows, cols)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = block.each_block(batches, grid)
        yield from _pieces((bi, bj, nr, nc, *_compressed(pos, values, nr, nc)) for bi, bj, nr, nc, pos, values in blocks)

    return BlockMatrix(block.cells_by_block(entries, grid, unique).mapInArrow(compress, SCHEMA), grid, stored)


def _each(batch: pa.RecordBatch):
    """(bi, bj, nr, nc, starts, places, values) of every block of a batch."""
    keys = zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)
    for key, *cells in zip(keys, *(batch.column(c) for c in (4, 5, 6)), strict=True):
        yield (*key, *(c.values.to_numpy() for c in cells))


def to_entries(matrix: BlockMatrix) -> DataFrame:
    """Every stored cell as an entry ``(i, j, v)``."""
    grid = matrix.grid

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, _, nc, starts, places, values in _each(batch):
                columns = np.repeat(np.arange(nc, dtype=np.int64), np.diff(starts))
                i, j = bi * grid.block_rows + places.astype(np.int64), bj * grid.block_cols + columns
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(values)], ["i", "j", "v"])

    return matrix.blocks.mapInArrow(spread, "i bigint, j bigint, v double")


def transpose(matrix: BlockMatrix) -> BlockMatrix:
    """Swap the keys and compress every block by its rows, without a shuffle."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for bi, bj, nr, nc, starts, places, values in _each(batch):
                columns = np.repeat(np.arange(nc, dtype=np.int64), np.diff(starts))
                yield (bj, bi, nc, nr, *_compressed(places.astype(np.int64) * nc + columns, values, nc, nr))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pieces(turned(batches))

    return BlockMatrix(matrix.blocks.mapInArrow(turn, SCHEMA), matrix.grid.transposed(), matrix.cells)


def to_dense(matrix: BlockMatrix) -> BlockMatrix:
    """Sparse blocks as dense ones, a few at a time."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, nr, nc, starts, places, values in _each(batch):
                cells = np.zeros((nr, nc), order="F")
                cells[places, np.repeat(np.arange(nc), np.diff(starts))] = values
                yield from product.block_rows({(bi, bj): cells})

    return BlockMatrix(matrix.blocks.mapInArrow(fill, block.SCHEMA), matrix.grid)


def to_sparse(matrix: BlockMatrix) -> BlockMatrix:
    """Dense blocks without their zeros; a block without cells is left out."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True)
            for bi, bj, nr, nc, data in keys:
                values = data.values.to_numpy()
                pos = np.flatnonzero(values)
                if len(pos):
                    yield bi, bj, nr, nc, np.searchsorted(pos, np.arange(nc + 1) * nr), pos % nr, values[pos]

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pieces(stored(batches))

    return BlockMatrix(matrix.blocks.mapInArrow(drop, SCHEMA), matrix.grid)


def validate(matrix: BlockMatrix) -> DataFrame:
    """One row ``(rule, bi, bj, detail)`` per broken rule and block; empty for a sound matrix."""
    grid = matrix.grid
    bi, bj = F.col("bi"), F.col("bj")
    inside = (bi >= 0) & (bi < grid.row_blocks) & (bj >= 0) & (bj < grid.col_blocks)
    sized = (F.col("nr") == grid.height(bi)) & (F.col("nc") == grid.width(bj))
    rising = F.col("starts") == F.array_sort("starts")
    whole = (
        (F.size("starts") == F.col("nc") + 1) & (F.get("starts", F.lit(0)) == 0) & rising
        & (F.element_at("starts", -1) == F.size("data")) & (F.size("places") == F.size("data"))
    )
    rows = F.coalesce(F.array_min("places") >= 0, F.lit(True)) & F.coalesce(F.array_max("places") < F.col("nr"), F.lit(True))
    # Sizes and verdicts only from here on: no block data is shuffled.
    facts = matrix.blocks.select("bi", "bj", inside.alias("inside"), sized.alias("sized"), (whole & rows).alias("sound"))
    found = facts.groupBy("bi", "bj").agg(
        F.count("*").alias("detail"), F.bool_and("inside").alias("inside"), F.bool_and("sized").alias("sized"), F.bool_and("sound").alias("sound")
    )
    rules = F.array(
        F.when(F.col("detail") > 1, F.lit("duplicate block")),
        F.when(~F.col("inside"), F.lit("block outside the grid")),
        F.when(F.col("inside") & ~F.col("sized"), F.lit("wrong block size")),
        F.when(~F.col("sound"), F.lit("broken columns")),
    )
    return found.select(F.explode(F.array_compact(rules)).alias("rule"), "bi", "bj", "detail")
