"""A sparse matrix laid out in two-dimensional tiles, for repeated products with tall factors.

Row ids and column ids are dealt over the block rows and columns of a grid, and the grid is cut into tiles shaped like the
matrix (``block.tile_sides``, ``block.tile_number``). A tile's cells lie packed in one partition. A product sends each
factor row to the tiles of its stripe, adds inside the tile, and adds the tiles' sums along the other side, so with T
tiles a factor row is copied and a sum is sent about sqrt(T) times, where a layout by one index sends T sums of it.

An id that holds more than an even share of the cells is hot: its cells are dealt over its stripe's whole length by their other id,
and its factor row goes to every tile that holds cells of it; these tiles are kept as a table. By the default share there are
at most as many such ids as partitions; where a caller asks for a low share there may be many, and a row still goes to no
more tiles than its id has cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from blockweave.functions import arrow
from blockweave.operators import block, factor, product
from blockweave.session import BROADCAST_BYTES, ENTRY_BYTES, cut

#: Cells a tile should hold at most, and cells a task packs at once.
TILE_CELLS, PACK_CELLS = 4_000_000, 1_000_000
#: Tiles for each partition, so that hashing them over partitions evens out.
TILES_PER_PARTITION = 2
#: Doubles of products held at once.
TERMS = 1 << 21
PACKED = "tile int, n int, i binary, j binary, v binary"


@dataclass(frozen=True)
class Tiling:
    """A grid of id groups cut into ``down`` x ``across`` tiles of ``sides`` groups."""

    grid: block.Grid
    sides: tuple[int, int]

    @property
    def down(self) -> int:
        return -(-self.grid.row_blocks // self.sides[0])

    @property
    def across(self) -> int:
        return -(-self.grid.col_blocks // self.sides[1])

    @property
    def tiles(self) -> int:
        return self.down * self.across


def choose_tiling(rows: int, cols: int, cells: int, partitions: int) -> Tiling:
    """Tiles shaped like a rows x cols matrix, enough for the partitions and for the size of a tile.

    ``rows`` and ``cols`` are numbers of ids. The grid has up to 64 groups of ids a tile side.
    """
    tiles = max(TILES_PER_PARTITION * partitions, -(-cells // TILE_CELLS), 1)
    # square groups: as many along a side as it has ids, but no more than the tiles can use
    step = max(1, max(rows, cols, 1) // (64 * tiles))
    grid = block.Grid(-(-max(rows, 1) // step), -(-max(cols, 1) // step), 1, 1)
    return Tiling(grid, product.stretched_sides(grid.row_blocks, grid.col_blocks, tiles))


def _group(index: str, groups: int, other: bool = False) -> Column:
    """Group of an id, or of the other id of a hot one: a second hash, independent of the first."""
    place = F.xxhash64(F.lit("open"), index) if other else F.xxhash64(index)
    return F.pmod(place, F.lit(groups)).cast("int")


def _marked(df: DataFrame, index: str, hot: list[int], name: str) -> DataFrame:
    """``df`` with a column that says whether an id is hot."""
    if not hot:
        return df.withColumn(name, F.lit(False))
    ids = pa.table({"hot_id": pa.array(hot, pa.int64()), name: pa.array([True] * len(hot))})
    table = df.sparkSession.createDataFrame(ids)
    table = F.broadcast(table) if len(hot) * ENTRY_BYTES <= BROADCAST_BYTES else table.hint("merge")
    found = df.join(table, F.col(index) == F.col("hot_id"), "left").drop("hot_id")
    return found.withColumn(name, F.coalesce(name, F.lit(False)))


class TiledMatrix:
    """Cells ``(i, j, v)``, one an index pair, in tiles; ``by_row`` and ``by_col`` are the two products."""

    def __init__(
        self, cells: DataFrame, tiling: Tiling, partitions: int, hot_rows: list[int], hot_cols: list[int], reuse: bool = True
    ):
        self.tiling, self.partitions = tiling, partitions
        grid = tiling.grid
        marked = _marked(_marked(cells, "i", hot_rows, "hot_i"), "j", hot_cols, "hot_j")
        # the stripe of a hot id is open: the other id decides
        bi = F.when(F.col("hot_i"), _group("j", grid.row_blocks, True)).otherwise(_group("i", grid.row_blocks))
        bj = F.when(F.col("hot_j"), _group("i", grid.col_blocks, True)).otherwise(_group("j", grid.col_blocks))
        placed = marked.select(bi.alias("bi"), bj.alias("bj"), "i", "j", "v", "hot_i", "hot_j").select(
            block.tile_number(grid, tiling.sides).alias("tile"), "i", "j", "v", "hot_i", "hot_j"
        )
        packs = placed.select("tile", "i", "j", "v").mapInArrow(_pack, PACKED).repartition(partitions, "tile")
        if reuse:
            packs = packs.persist(StorageLevel.MEMORY_AND_DISK)
            # a filled cache tells later plans how it is partitioned
            packs.count()
        self.packs, self._reuse = packs, reuse
        self.by_row = Side(self, "i", "j", hot_rows, _places(placed, "i", hot_rows))
        self.by_col = Side(self, "j", "i", hot_cols, _places(placed, "j", hot_cols))

    def release(self) -> None:
        if self._reuse:
            self.packs.unpersist()


def _places(placed: DataFrame, index: str, hot: list[int]) -> DataFrame | None:
    """``tile, id``: the tiles that hold cells of each hot id."""
    if not hot:
        return None
    return cut(placed.where(F.col(f"hot_{index}")).select("tile", F.col(index).alias("id")).distinct())


@dataclass
class Side:
    """The product with factor rows of ``key``: sums for each id of ``other``."""

    matrix: TiledMatrix
    key: str
    other: str
    hot_keys: list[int]
    hot_places: DataFrame | None = None

    def routed(self, factor_rows: DataFrame) -> DataFrame:
        """``tile, id, f``: factor rows in every tile that may hold their cells."""
        tiling = self.matrix.tiling
        grid, (height, width), down, across = tiling.grid, tiling.sides, tiling.down, tiling.across
        if self.key == "i":
            first, step, count = F.expr(f"cast(g div {height} as int)"), down, across
            groups = grid.row_blocks
        else:
            first, step, count = F.expr(f"cast(g div {width} * {down} as int)"), 1, down
            groups = grid.col_blocks
        stripe = F.sequence(first, first + F.lit(step * (count - 1)), F.lit(step))
        marked = _marked(factor_rows.select("id", "f"), "id", self.hot_keys, "hot")
        plain = marked.where(~F.col("hot")).select("id", "f", _group("id", groups).alias("g"))
        plain = plain.select(F.explode(stripe).alias("tile"), "id", "f")
        if self.hot_places is None:
            return plain
        spread = marked.where("hot").select("id", "f").join(self.hot_places.hint("merge"), "id")
        return plain.unionAll(spread.select("tile", "id", "f"))

    def partial_sums(self, factor_rows: DataFrame, rank: int) -> DataFrame:
        """``id, f``: for each tile, the sum of v·f over its cells of each other id."""
        kernel = _kernel(3 if self.key == "i" else 2, rank)
        routed = self.routed(factor_rows).repartition(self.matrix.partitions, "tile")
        return self.matrix.packs.groupBy("tile").cogroup(routed.groupBy("tile")).applyInArrow(kernel, "id bigint, f array<double>")

    def project(self, factor_rows: DataFrame, rank: int) -> DataFrame:
        """Σ v·f over the cells of each other id: WᵀA or AHᵀ in factor form."""
        sums = self.partial_sums(factor_rows, rank)
        return factor.weighted_sums(sums.select("id", F.lit(1.0).alias("v"), "f"), rank)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, i, j, v) to packs of a tile's cells."""
    held: list[list[np.ndarray]] = []

    def release() -> pa.RecordBatch:
        tile, *cells = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.argsort(tile, kind="stable")
        tile, cells = tile[order], [c[order] for c in cells]
        starts = np.flatnonzero(np.diff(tile, prepend=-1))
        ends = np.append(starts[1:], len(tile))
        packs = [pa.array([c[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()) for c in cells]
        numbers = [pa.array(tile[starts].astype(np.int32)), pa.array((ends - starts).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*numbers, *packs], ["tile", "n", "i", "j", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "i", "j", "v")])
        if sum(len(h[0]) for h in held) >= PACK_CELLS:
            yield release()
    if held:
        yield release()


def _kernel(sum_column: int, rank: int):
    """Sums of one tile. ``sum_column`` is the pack's column of the ids that the sums are for."""
    schema = pa.schema([("id", pa.int64()), ("f", pa.list_(pa.float64()))])

    def run(packs: pa.Table, rows: pa.Table) -> pa.Table:
        if not packs.num_rows:
            return schema.empty_table()
        i, j, v = (np.frombuffer(b"".join(packs.column(c).to_pylist()), t) for c, t in ((2, "<i8"), (3, "<i8"), (4, "<f8")))
        key, other = (i, j) if sum_column == 3 else (j, i)
        ids = rows["id"].to_numpy()
        f = arrow.to_matrix(rows["f"]) if rows.num_rows else np.empty((0, rank))
        if rows.num_rows and f.shape[1] != rank:
            raise ValueError(f"expected factor rows of {rank} values but got {f.shape[1]}")
        by = np.argsort(ids)
        at = np.searchsorted(ids[by], key)
        lost = (at == len(ids)) | (ids[by][np.minimum(at, len(ids) - 1)] != key) if len(ids) else np.ones(len(key), bool)
        if lost.any():
            raise ValueError(f"no factor row for id {key[lost][0]}")
        at = by[at]
        order = np.argsort(other, kind="stable")
        other, at, v = other[order], at[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], other[1:] != other[:-1]]))
        target = np.cumsum(np.concatenate([[0], other[1:] != other[:-1]]))
        total = np.zeros((len(first), rank))
        step = max(1, TERMS // max(rank, 1))
        for start in range(0, len(other), step):
            part = slice(start, start + step)
            heads = np.flatnonzero(np.diff(target[part], prepend=-1))
            total[target[part][heads]] += np.add.reduceat(v[part, None] * f[at[part]], heads, axis=0)
        return pa.table([pa.array(other[first]), arrow.to_lists(total)], schema=schema)

    return run
