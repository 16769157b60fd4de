"""Products of block matrices, dense or sparse, by output tile.

The output is cut into tiles of blocks. Every block of the left matrix goes to the tiles of its block row, every block of the
right one to the tiles of its block column, and a tile's blocks are sorted by inner index and multiplied as they
stream by: one shuffle, no partial products. Where the output has too few tiles for the work, or repeating the
inputs would cost more than adding outputs, the inner dimension is cut into slabs as well and the slabs' results are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.functions import arrow

#: Output blocks of a tile and left blocks of one inner index, in bytes.
HELD_BYTES = 128 * 1024 * 1024
#: Bytes of blocks handed on at once, and of terms of a sparse product held at once.
PIECE_BYTES = 16 * 1024 * 1024
#: What a further shuffle is worth, in bytes moved.
STAGE_BYTES = 32 * 1024 * 1024
#: Multiplications that are worth a task of their own.
TASK_WORK = 2_000_000_000
DENSE = "bi int, bj int, nr int, nc int, data array<double>"


def tile_sides(row_blocks: int, col_blocks: int, tiles: int) -> tuple[int, int]:
    """Block rows and columns of a tile when a grid is cut into about ``tiles`` tiles shaped like itself."""
    if tiles < 1:
        raise ValueError("the number of tiles must be at least 1")
    root = math.sqrt(tiles)
    height, width = (max(1, math.floor(n / root + 0.5)) for n in (row_blocks, col_blocks))
    return height, width


def stretched_sides(row_blocks: int, col_blocks: int, tiles: int) -> tuple[int, int]:
    """``tile_sides``, but a grid too narrow for so many tiles is cut further along its longer side."""
    height, width = tile_sides(row_blocks, col_blocks, tiles)
    down, across = -(-row_blocks // height), -(-col_blocks // width)
    if 2 * down * across < tiles:
        if row_blocks >= col_blocks:
            height = max(1, row_blocks * max(across, 1) // tiles)
        else:
            width = max(1, col_blocks * max(down, 1) // tiles)
    return height, width


@dataclass(frozen=True)
class Layout:
    """Sides of an output tile in blocks, tiles down and across, and slabs of the inner dimension."""

    height: int
    width: int
    down: int
    across: int
    slabs: int
    #: Inner blocks in a slab.
    depth: int

    def moved(self, left: int, right: int, output: int) -> int:
        """Bytes shuffled, for matrices of these sizes."""
        added = output * self.slabs + STAGE_BYTES if self.slabs > 1 else 0
        return left * self.across + right * self.down + added


def choose_layout(
    row_blocks: int, inner_blocks: int, col_blocks: int, *, tasks: int, work: float,
    left_bytes: int, right_bytes: int, output_bytes: int, block_bytes: int, held: int = HELD_BYTES,
) -> Layout:
    """The layout that moves the fewest bytes among those with enough tasks and small enough tiles."""
    wanted = max(1, min(tasks, math.ceil(work / TASK_WORK)))
    found: list[tuple[bool, int, Layout]] = []
    tiles, most = 1, max(tasks, math.ceil(row_blocks * col_blocks * block_bytes / held))
    while True:
        height, width = stretched_sides(row_blocks, col_blocks, tiles)
        while height * width * block_bytes > held and height * width > 1:
            height, width = (-(-height // 2), width) if height >= width else (height, -(-width // 2))
        down, across = -(-row_blocks // height), -(-col_blocks // width)
        for slabs in {1, min(inner_blocks, -(-wanted // max(down * across, 1)))}:
            depth = max(1, -(-inner_blocks // max(slabs, 1)))
            layout = Layout(height, width, down, across, -(-inner_blocks // depth) or 1, depth)
            short = down * across * layout.slabs < min(wanted, row_blocks * col_blocks * inner_blocks)
            found.append((short, layout.moved(left_bytes, right_bytes, output_bytes), layout))
        if tiles >= most:
            break
        tiles = min(2 * tiles, most)
    return min(found, key=lambda f: (f[0], f[1], f[2].slabs))[2]


@dataclass
class Sparse:
    """A compressed-column block: column c holds ``places[starts[c]:starts[c + 1]]`` and their values."""

    rows: int
    starts: np.ndarray
    places: np.ndarray
    values: np.ndarray
    _by_row: tuple | None = field(default=None, repr=False)

    @property
    def cols(self) -> int:
        return len(self.starts) - 1

    @property
    def columns(self) -> np.ndarray:
        return np.repeat(np.arange(self.cols), np.diff(self.starts))

    def by_row(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) in order of row."""
        if self._by_row is None:
            order = np.argsort(self.places, kind="stable")
            self._by_row = self.places[order], self.columns[order], self.values[order]
        return self._by_row


def _slices(count: int, width: int) -> Iterator[slice]:
    step = max(1, PIECE_BYTES // (8 * max(width, 1)))
    for start in range(0, count, step):
        yield slice(start, start + step)


def add_product(total: np.ndarray, a, b) -> None:
    """``total += a @ b`` for dense arrays and sparse blocks; nothing sparse is made dense."""
    if not isinstance(a, Sparse) and not isinstance(b, Sparse):
        total += a @ b
    elif not isinstance(b, Sparse):
        rows, cols, values = a.by_row()
        for part in _slices(len(rows), b.shape[1]):
            first = np.flatnonzero(np.diff(rows[part], prepend=-1))
            terms = values[part, None] * b[cols[part]]
            total[rows[part][first]] += np.add.reduceat(terms, first, axis=0)
    elif not isinstance(a, Sparse):
        columns = b.columns
        for part in _slices(len(columns), a.shape[0]):
            first = np.flatnonzero(np.diff(columns[part], prepend=-1))
            terms = a[:, b.places[part]] * b.values[part]
            total[:, columns[part][first]] += np.add.reduceat(terms, first, axis=1)
    else:
        # every entry (k, j) of b meets column k of a
        columns, lengths = b.columns, np.diff(a.starts)[b.places]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return
        bounds = np.searchsorted(ends, np.arange(0, int(ends[-1]), PIECE_BYTES // 8), side="right")
        for low, high in zip(bounds, np.append(bounds[1:], len(lengths)), strict=True):
            n = lengths[low:high]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(a.starts[b.places[low:high]], n) + inside
            terms = a.values[at] * np.repeat(b.values[low:high], n)
            np.add.at(total, (a.places[at], np.repeat(columns[low:high], n)), terms)


def _matrix(nr: int, nc: int, starts: pa.Scalar, places: pa.Scalar, data: pa.Scalar):
    values = data.values.to_numpy()
    if starts.is_valid:
        return Sparse(nr, starts.values.to_numpy(), places.values.to_numpy(), values)
    return values.reshape(nr, nc, order="F")


def block_rows(blocks: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Dense blocks as rows, a few at a time; ``blocks`` is emptied."""
    while blocks:
        keys, size = [], 0
        for key in blocks:
            keys.append(key)
            size += blocks[key].nbytes
            if size > PIECE_BYTES:
                break
        parts = [blocks.pop(k) for k in keys]
        numbers = [[k[0] for k in keys], [k[1] for k in keys], [p.shape[0] for p in parts], [p.shape[1] for p in parts]]
        data = arrow.vector_rows([p.reshape(-1, order="F") for p in parts])
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(n, pa.int32()) for n in numbers), data], ["bi", "bj", "nr", "nc", "data"]
        )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (tile, slab, inner index, side) to the output blocks of each tile and slab."""
    held: dict[tuple[int, int], np.ndarray] = {}
    left: list[tuple[int, object, int]] = []
    cell = inner = None
    for batch in batches:
        names = ("tile", "slab", "bk", "side", "at", "nr", "nc")
        numbers = zip(*(batch.column(n).to_pylist() for n in names), strict=True)
        payload = zip(*(batch.column(n) for n in ("starts", "places", "data")), strict=True)
        for (tile, slab, bk, side, at, nr, nc), cells in zip(numbers, payload, strict=True):
            if (tile, slab) != cell:
                yield from block_rows(held)
                cell, inner = (tile, slab), None
            if bk != inner:
                inner = bk
                left.clear()
            block = _matrix(nr, nc, *cells)
            if side == 0:
                left.append((at, block, nr))
                continue
            for bi, a, height in left:
                if (bi, at) not in held:
                    held[bi, at] = np.zeros((height, nc), order="F")
                add_product(held[bi, at], a, block)
    yield from block_rows(held)


def _payload(blocks: DataFrame) -> list:
    """The three payload columns; a dense block has no starts."""
    absent = F.lit(None).cast("array<int>")
    if "starts" in blocks.columns:
        return [F.col("starts"), F.col("places"), F.col("data")]
    return [absent.alias("starts"), absent.alias("places"), F.col("data")]


def by_tiles(left: DataFrame, right: DataFrame, layout: Layout) -> DataFrame:
    """Blocks ``(bi, bj, nr, nc, data)`` of the product of two tables of blocks."""

    def routed(blocks: DataFrame, side: int, own: str, inner: str, tile, copies: int) -> DataFrame:
        copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
        rows = blocks.select(copy, F.col(own).alias("at"), F.col(inner).alias("bk"), "nr", "nc", *_payload(blocks))
        return rows.select(
            tile.cast("int").alias("tile"), F.expr(f"cast(bk div {layout.depth} as int)").alias("slab"), "bk",
            F.lit(side).alias("side"), "at", "nr", "nc", "starts", "places", "data",
        )

    # a tile's number is its row plus its column times the tiles down, as in ``tile_number``
    rows = routed(left, 0, "bi", "bj", F.expr(f"at div {layout.height} + copy * {layout.down}"), layout.across)
    cols = routed(right, 1, "bj", "bi", F.expr(f"copy + at div {layout.width} * {layout.down}"), layout.down)
    order = ["tile", "slab", "bk", "side"]
    dealt = rows.unionAll(cols).repartition("tile", "slab").sortWithinPartitions(*order)
    product = dealt.mapInArrow(_stream, DENSE)
    return product if layout.slabs == 1 else added(product)


def added(partial: DataFrame) -> DataFrame:
    """Sum of dense blocks with equal keys."""
    return (
        partial.groupBy("bi", "bj", "nr", "nc")
        .agg(Summarizer.sum(array_to_vector("data")).alias("data"))
        .select("bi", "bj", "nr", "nc", vector_to_array("data").alias("data"))
    )


def _each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            bi, bj, nr, inner, nc = (batch.column(c)[n].as_py() for c in ("bi", "bj", "nr", "inner", "nc"))
            a = _matrix(nr, inner, *(batch.column(c)[n] for c in ("starts", "places", "data")))
            b = _matrix(inner, nc, *(batch.column(c)[n] for c in ("b_starts", "b_places", "b_data")))
            total = np.zeros((nr, nc), order="F")
            add_product(total, a, b)
            yield from block_rows({(bi, bj): total})


def by_broadcast(left: DataFrame, right: DataFrame, small: str) -> DataFrame:
    """The product where the inner dimension is one block and a side is small: no shuffle, nothing to add."""
    a = left.select("bi", F.col("bj").alias("bk"), "nr", F.col("nc").alias("inner"), *_payload(left))
    named = [c.alias(f"b_{n}") for c, n in zip(_payload(right), ("starts", "places", "data"), strict=True)]
    b = right.select(F.col("bi").alias("bk"), "bj", "nc", *named)
    pairs = F.broadcast(a).join(b, "bk") if small == "left" else a.join(F.broadcast(b), "bk")
    return pairs.mapInArrow(_each_pair, DENSE)
