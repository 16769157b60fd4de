"""Dense matrices in block form: ``(bi int, bj int, nr int, nc int, data array<double>)``.

``data`` is column-major. The grid (sizes of the matrix and of its blocks) is plain data next to the
DataFrame. A block that is not there is zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.functions import arrow
from blockweave.functions.columns import hash_uniform
from blockweave.operators import entry, product
from blockweave.session import BROADCAST_BYTES, MAX_BLOCK_CELLS, shuffle_partitions

SCHEMA = "bi int, bj int, nr int, nc int, data array<double>"
#: Dense blocks a task holds before it passes them on, in bytes.
HELD_BYTES = 16 * 1024 * 1024


@dataclass(frozen=True)
class Grid:
    """Size of a matrix and of its blocks; the last row and column of blocks may be smaller."""

    rows: int
    cols: int
    block_rows: int
    block_cols: int

    def __post_init__(self):
        if self.rows < 0 or self.cols < 0:
            raise ValueError("matrix size must not be negative")
        if self.block_rows < 1 or self.block_cols < 1:
            raise ValueError("block size must be at least 1")
        if self.block_rows * self.block_cols > MAX_BLOCK_CELLS:
            raise ValueError(f"a block may hold at most {MAX_BLOCK_CELLS} cells")

    @property
    def row_blocks(self) -> int:
        return -(-self.rows // self.block_rows)

    @property
    def col_blocks(self) -> int:
        return -(-self.cols // self.block_cols)

    @property
    def data_bytes(self) -> int:
        return self.rows * self.cols * 8

    def transposed(self) -> Grid:
        return Grid(self.cols, self.rows, self.block_cols, self.block_rows)

    def height(self, bi: Column) -> Column:
        """Rows of the blocks in block row ``bi``."""
        return F.least(F.lit(self.block_rows), F.lit(self.rows) - bi * self.block_rows).cast("int")

    def width(self, bj: Column) -> Column:
        return F.least(F.lit(self.block_cols), F.lit(self.cols) - bj * self.block_cols).cast("int")


@dataclass(frozen=True)
class BlockMatrix:
    """Blocks and their grid. The blocks may be sparse (``operators.sparse_block``); ``cells`` is how many they store."""

    blocks: DataFrame
    grid: Grid
    cells: int | None = None

    @property
    def stored_bytes(self) -> int:
        """Bytes of all blocks; of dense ones where the number of cells is not known."""
        return self.grid.data_bytes if self.cells is None else 12 * self.cells


def from_keyed_blocks(
    blocks: DataFrame, block_rows: int, block_cols: int, rows: int | None = None, cols: int | None = None
) -> BlockMatrix:
    """A matrix from rows of the block schema; sizes not given are read off the block keys."""
    blocks = blocks.select(
        F.col("bi").cast("int"), F.col("bj").cast("int"),
        F.col("nr").cast("int"), F.col("nc").cast("int"), "data",
    )
    if rows is None or cols is None:
        size = blocks.agg(
            F.coalesce(F.max(F.col("bi").cast("bigint") * block_rows + F.col("nr")), F.lit(0)),
            F.coalesce(F.max(F.col("bj").cast("bigint") * block_cols + F.col("nc")), F.lit(0)),
        ).first()
        rows = size[0] if rows is None else rows
        cols = size[1] if cols is None else cols
    return BlockMatrix(blocks, Grid(rows, cols, block_rows, block_cols))


def block_grid(spark: SparkSession, row_blocks: int, col_blocks: int) -> DataFrame:
    """All block coordinates ``(bi, bj)``."""
    return spark.range(row_blocks * col_blocks).select(
        F.expr(f"cast(id div {max(col_blocks, 1)}L as int)").alias("bi"),
        (F.col("id") % max(col_blocks, 1)).cast("int").alias("bj"),
    )


def random_blocks(
    spark: SparkSession, grid: Grid, seed: int, uniform: Callable[..., Column] = hash_uniform
) -> BlockMatrix:
    """A dense matrix of uniform values in [0, 1); a cell depends on its position and the seed only.

    ``uniform`` is an expression of the row, the column and the seed, by default a hash.
    """
    coords = block_grid(spark, grid.row_blocks, grid.col_blocks)
    sized = coords.select(
        "bi", "bj", grid.height(F.col("bi")).alias("nr"), grid.width(F.col("bj")).alias("nc")
    )
    row = F.col("bi").cast("bigint") * grid.block_rows
    col = F.col("bj").cast("bigint") * grid.block_cols

    def cell(pos: Column) -> Column:
        inner = pos % F.col("nr")
        outer = F.floor(pos / F.col("nr"))
        return uniform(row + inner, col + outer, seed=seed)

    data = F.transform(F.sequence(F.lit(0), F.col("nr") * F.col("nc") - 1), cell)
    return BlockMatrix(sized.withColumn("data", data), grid)


def grid_of(entries: DataFrame, block_rows: int, block_cols: int, rows: int | None, cols: int | None) -> Grid:
    """The grid, with sizes that are not given read off the entries."""
    if rows is None or cols is None:
        size = entry.matrix_shape(entries).first()
        rows = size["rows"] if rows is None else rows
        cols = size["cols"] if cols is None else cols
    return Grid(rows, cols, block_rows, block_cols)


def cells_by_block(entries: DataFrame, grid: Grid, unique: bool = False) -> DataFrame:
    """``block, pos, v``: the entries with the number of their block and their place in it, column after column.

    A block's cells are in one partition and follow each other; ``each_block`` gathers them.
    """
    inside = (F.col("i") >= 0) & (F.col("i") < grid.rows) & (F.col("j") >= 0) & (F.col("j") < grid.cols)
    bi, bj = F.expr(f"i div {grid.block_rows}L"), F.expr(f"j div {grid.block_cols}L")
    position = F.when(
        inside, (F.col("j") % grid.block_cols) * grid.height(bi) + F.col("i") % grid.block_rows
    ).otherwise(F.raise_error(F.lit("entry outside the matrix")).cast("bigint"))
    cells = (entries if unique else entry.sum_duplicates(entries)).select(
        (bi * max(grid.col_blocks, 1) + bj).alias("block"), position.cast("int").alias("pos"), "v"
    )
    return cells.repartition("block").sortWithinPartitions("block")


def each_block(
    batches: Iterator[pa.RecordBatch], grid: Grid
) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """(bi, bj, nr, nc, places, values) of every block of ``cells_by_block``, one at a time."""
    number, pos, values = None, [], []

    def whole():
        bi, bj = divmod(number, max(grid.col_blocks, 1))
        nr = min(grid.block_rows, grid.rows - bi * grid.block_rows)
        nc = min(grid.block_cols, grid.cols - bj * grid.block_cols)
        return bi, bj, nr, nc, np.concatenate(pos), np.concatenate(values)

    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, places, cells = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        first = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1))
        for start, end in zip(first, np.append(first[1:], len(blocks)), strict=True):
            if blocks[start] != number:
                if number is not None:
                    yield whole()
                number, pos, values = int(blocks[start]), [], []
            pos.append(places[start:end])
            values.append(cells[start:end])
    if number is not None:
        yield whole()


def to_blocks(
    entries: DataFrame,
    block_rows: int,
    block_cols: int,
    rows: int | None = None,
    cols: int | None = None,
    unique: bool = False,
) -> BlockMatrix:
    """Entries to dense blocks; repeated cells are added up and the last blocks are smaller.

    A block collects at most block_rows * block_cols cells, because cells are summed before. Pass
    ``unique=True`` to save that shuffle when there is one entry per cell.
    """
    grid = grid_of(entries, block_rows, block_cols, rows, cols)

    def scatter(batches):
        # a dense block may be far larger than its cells: hand on a few at a time
        held, size = {}, 0
        for bi, bj, nr, nc, pos, values in each_block(batches, grid):
            held[bi, bj] = np.bincount(pos, weights=values, minlength=nr * nc).reshape(nr, nc, order="F")
            size += held[bi, bj].nbytes
            if size > HELD_BYTES:
                yield from product.block_rows(held)
                size = 0
        yield from product.block_rows(held)

    return BlockMatrix(cells_by_block(entries, grid, unique).mapInArrow(scatter, SCHEMA), grid)


def to_entries(matrix: BlockMatrix) -> DataFrame:
    """Every stored cell as an entry ``(i, j, v)``, explicit zeros included."""
    grid = matrix.grid
    return matrix.blocks.select("bi", "bj", "nr", F.posexplode("data").alias("pos", "v")).select(
        (F.col("bi").cast("bigint") * grid.block_rows + F.col("pos") % F.col("nr")).alias("i"),
        (F.col("bj").cast("bigint") * grid.block_cols + F.expr("pos div nr")).alias("j"),
        "v",
    )


def transpose(matrix: BlockMatrix) -> BlockMatrix:
    """Swap the keys and turn every block, without a shuffle."""

    def turn(batches):
        for batch in batches:
            bi, bj, nr, nc, data = batch.columns
            turned = [
                v.values.to_numpy().reshape(c, r).T.reshape(-1)
                for v, r, c in zip(data, nr.to_pylist(), nc.to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [bj, bi, nc, nr, arrow.vector_rows(turned)], ["bi", "bj", "nr", "nc", "data"]
            )

    return BlockMatrix(matrix.blocks.mapInArrow(turn, SCHEMA), matrix.grid.transposed())


def multiply(a: BlockMatrix, b: BlockMatrix) -> BlockMatrix:
    """Matrix product of two matrices, each dense or sparse: a dense matrix.

    Where the inner dimension is one block and a side is below the broadcast limit, that side is broadcast. Otherwise the
    blocks meet in tiles of the output (``operators.product``).
    """
    if a.grid.cols != b.grid.rows:
        raise ValueError(f"cannot multiply: {a.grid.cols} columns against {b.grid.rows} rows")
    if a.grid.block_cols != b.grid.block_rows:
        raise ValueError("cannot multiply: different inner block sizes")
    grid = Grid(a.grid.rows, b.grid.cols, a.grid.block_rows, b.grid.block_cols)
    small = min((b, "right"), (a, "left"), key=lambda side: side[0].stored_bytes)
    if a.grid.col_blocks <= 1 and small[0].stored_bytes <= BROADCAST_BYTES:
        return BlockMatrix(product.by_broadcast(a.blocks, b.blocks, small[1]), grid)
    return BlockMatrix(product.by_tiles(a.blocks, b.blocks, product_layout(a, b)), grid)


def product_layout(a: BlockMatrix, b: BlockMatrix) -> product.Layout:
    """How the blocks of a product are dealt, from the sizes of the matrices alone."""
    out = Grid(a.grid.rows, b.grid.cols, a.grid.block_rows, b.grid.block_cols)
    return product.choose_layout(
        out.row_blocks, a.grid.col_blocks, out.col_blocks,
        tasks=shuffle_partitions(a.blocks.sparkSession),
        work=min(a.stored_bytes / 8 * b.grid.cols, a.grid.rows * b.stored_bytes / 8),
        left_bytes=a.stored_bytes, right_bytes=b.stored_bytes, output_bytes=out.data_bytes,
        block_bytes=out.block_rows * out.block_cols * 8,
    )


def _same_grid(*matrices: BlockMatrix) -> Grid:
    grids = {m.grid for m in matrices}
    if len(grids) != 1:
        raise ValueError("cannot combine matrices with different sizes or block sizes")
    return grids.pop()


def _aligned(*matrices: BlockMatrix) -> DataFrame:
    """Blocks of all matrices side by side as ``d0, d1, ...``; missing ones are zeros."""
    joined = matrices[0].blocks.select("bi", "bj", F.col("data").alias("d0"))
    for n, matrix in enumerate(matrices[1:], start=1):
        joined = joined.join(
            matrix.blocks.select("bi", "bj", F.col("data").alias(f"d{n}")), ["bi", "bj"], "full"
        )
    grid = matrices[0].grid
    sized = joined.withColumn("nr", grid.height(F.col("bi"))).withColumn(
        "nc", grid.width(F.col("bj"))
    )
    zeros = F.array_repeat(F.lit(0.0), F.col("nr") * F.col("nc"))
    filled = [F.coalesce(f"d{n}", zeros).alias(f"d{n}") for n in range(len(matrices))]
    return sized.select("bi", "bj", "nr", "nc", *filled)


def _combined(rows: DataFrame, data: Column, grid: Grid) -> BlockMatrix:
    return BlockMatrix(rows.select("bi", "bj", "nr", "nc", data.alias("data")), grid)


def elementwise_product(a: BlockMatrix, b: BlockMatrix) -> BlockMatrix:
    grid = _same_grid(a, b)

    @F.arrow_udf("array<double>")
    def multiplied(x: pa.Array, y: pa.Array) -> pa.Array:
        return arrow.elementwise(np.multiply, x, y)

    return _combined(_aligned(a, b), multiplied("d0", "d1"), grid)


def elementwise_division(a: BlockMatrix, b: BlockMatrix) -> BlockMatrix:
    """A⊘B with IEEE results: 0/0 is NaN, x/0 is infinite; a block that both lack is all 0/0."""
    grid = _same_grid(a, b)
    every = block_grid(a.blocks.sparkSession, grid.row_blocks, grid.col_blocks)
    absent = F.lit(None).cast("array<double>")
    a = BlockMatrix(
        every.join(a.blocks.select("bi", "bj", "data"), ["bi", "bj"], "left").withColumn("data", F.coalesce("data", absent)),
        grid,
    )

    @F.arrow_udf("array<double>")
    def quotient(x: pa.Array, y: pa.Array) -> pa.Array:
        return arrow.elementwise(np.divide, x, y)

    return _combined(_aligned(a, b), quotient("d0", "d1"), grid)


def multiply_divide(a: BlockMatrix, b: BlockMatrix, c: BlockMatrix) -> BlockMatrix:
    """A∘B⊘C in one pass; a zero product gives zero whatever the denominator is."""
    grid = _same_grid(a, b, c)

    def ratio(x, y, z):
        both = x * y
        return np.where(both == 0, 0.0, both / z)

    @F.arrow_udf("array<double>")
    def fused(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        return arrow.elementwise(ratio, x, y, z)

    return _combined(_aligned(a, b, c), fused("d0", "d1", "d2"), grid)


def validate(matrix: BlockMatrix) -> DataFrame:
    """One row ``(rule, bi, bj, detail)`` per broken rule and block; empty for a sound matrix."""
    grid, blocks = matrix.grid, matrix.blocks
    bi, bj = F.col("bi"), F.col("bj")
    inside = (bi >= 0) & (bi < grid.row_blocks) & (bj >= 0) & (bj < grid.col_blocks)
    stored = F.coalesce(F.size("data"), F.lit(0))
    fits = (
        (F.col("nr") == grid.height(bi))
        & (F.col("nc") == grid.width(bj))
        & (stored == F.col("nr") * F.col("nc"))
    )
    # Sizes only from here on: no block data is shuffled.
    facts = blocks.select("bi", "bj", inside.alias("inside"), fits.alias("fits"), stored.alias("stored"))
    found = facts.groupBy("bi", "bj").agg(
        F.count("*").alias("copies"),
        F.bool_and("inside").alias("inside"),
        F.bool_and("fits").alias("fits"),
        F.max("stored").alias("stored"),
    )
    faults = F.array(
        F.when(F.col("copies") > 1, F.struct(F.lit("duplicate block").alias("rule"),
                                             F.col("copies").cast("bigint").alias("detail"))),
        F.when(~F.col("inside"), F.struct(F.lit("block outside the grid").alias("rule"),
                                          F.col("copies").cast("bigint").alias("detail"))),
        F.when(F.col("inside") & ~F.col("fits"),
               F.struct(F.lit("wrong block size").alias("rule"),
                        F.col("stored").cast("bigint").alias("detail"))),
    )
    return (
        found.select("bi", "bj", F.explode(F.array_compact(faults)).alias("fault"))
        .select("fault.rule", "bi", "bj", "fault.detail")
    )


def tile_sides(grid: Grid, tiles: int) -> tuple[int, int]:
    """Block rows and columns of a tile when a grid is cut into about ``tiles`` tiles shaped like itself."""
    return product.tile_sides(grid.row_blocks, grid.col_blocks, tiles)


def tile_number(grid: Grid, sides: tuple[int, int]) -> Column:
    """Number of the tile that a block (bi, bj) lies in, column by column; a key to group neighbours by."""
    height, width = sides
    down = -(-grid.row_blocks // height)
    return F.expr(f"cast(bi div {height} + bj div {width} * {down} as int)")


def profile(matrix: BlockMatrix) -> DataFrame:
    """One row: sizes, block grid, mean block size and stored cells."""
    grid = matrix.grid
    return matrix.blocks.agg(F.coalesce(F.sum(F.size("data")), F.lit(0)).alias("stored")).select(
        F.lit(grid.rows).cast("bigint").alias("rows"),
        F.lit(grid.cols).cast("bigint").alias("cols"),
        F.lit(grid.row_blocks).cast("bigint").alias("row_blocks"),
        F.lit(grid.col_blocks).cast("bigint").alias("col_blocks"),
        F.lit(grid.rows // max(grid.row_blocks, 1)).cast("bigint").alias("block_rows"),
        F.lit(grid.cols // max(grid.col_blocks, 1)).cast("bigint").alias("block_cols"),
        F.col("stored").cast("bigint").alias("stored"),
    )
