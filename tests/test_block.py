import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix as StockBlocks
from pyspark.sql import functions as F

from blockweave.operators import block
from tests.conftest import entries_of, matrix_of

RNG = np.random.default_rng(3)


def blocks_of(spark, m, r, c):
    return block.to_blocks(entries_of(spark, m), r, c, *m.shape)


def dense_of(matrix):
    return matrix_of(block.to_entries(matrix), (matrix.grid.rows, matrix.grid.cols))


def test_ragged_blocks_and_back(spark):
    m = RNG.normal(size=(7, 5))
    b = blocks_of(spark, m, 3, 2)
    rows = {(r["bi"], r["bj"]): r for r in b.blocks.collect()}
    assert len(rows) == 9
    last = rows[2, 2]
    assert (last["nr"], last["nc"], last["data"]) == (1, 1, [m[6, 4]])
    assert np.array_equal(np.array(rows[0, 1]["data"]).reshape(3, 2, order="F"), m[:3, 2:4])
    assert np.array_equal(dense_of(b), m)


def test_duplicates_are_added_and_sizes_inferred(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (4, 6, 1.0)], "i bigint, j bigint, v double")
    b = block.to_blocks(df, 2, 3)
    assert (b.grid.rows, b.grid.cols) == (5, 7)
    assert dense_of(b)[1, 1] == 5.0
    assert b.blocks.count() == 2


def test_entry_outside_the_matrix_stops(spark):
    df = spark.createDataFrame([(5, 0, 1.0)], "i bigint, j bigint, v double")
    with pytest.raises(PySparkException, match="outside the matrix"):
        block.to_blocks(df, 2, 2, 4, 4).blocks.collect()


def test_bad_grids():
    for args in ((2, 2, 0, 1), (-1, 2, 1, 1), (2, 2, 1 << 20, 1 << 20)):
        with pytest.raises(ValueError):
            block.Grid(*args)


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("shape", [(9, 4, 3), (3, 4, 11), (2, 13, 2)])
def test_multiply_against_numpy_and_stock(spark, monkeypatch, limit, shape):
    if limit is not None:
        monkeypatch.setattr(block, "BROADCAST_BYTES", limit)
    m, k, n = shape
    a, b = RNG.normal(size=(m, k)), RNG.normal(size=(k, n))
    got = block.multiply(blocks_of(spark, a, 2, 3), blocks_of(spark, b, 3, 2))
    assert np.allclose(dense_of(got), a @ b)
    assert block.validate(got).count() == 0

    def stock(x, r, c):
        parts = []
        for bi in range(0, x.shape[0], r):
            for bj in range(0, x.shape[1], c):
                p = x[bi : bi + r, bj : bj + c]
                parts.append(((bi // r, bj // c), Matrices.dense(*p.shape, p.reshape(-1, order="F"))))
        return StockBlocks(spark.sparkContext.parallelize(parts), r, c)

    product = stock(a, 2, 3).multiply(stock(b, 3, 2)).toLocalMatrix().toArray()
    assert np.allclose(dense_of(got), product)


def test_multiply_checks_sizes(spark):
    a = blocks_of(spark, np.ones((4, 3)), 2, 2)
    with pytest.raises(ValueError, match="cannot multiply"):
        block.multiply(a, a)
    with pytest.raises(ValueError, match="inner block"):
        block.multiply(a, blocks_of(spark, np.ones((3, 4)), 1, 2))


def test_transpose(spark):
    m = RNG.normal(size=(5, 7))
    t = block.transpose(blocks_of(spark, m, 2, 3))
    assert np.array_equal(dense_of(t), m.T)
    assert block.validate(t).count() == 0


def test_elementwise_with_missing_blocks(spark):
    a, b, c = (RNG.normal(size=(5, 4)) for _ in range(3))
    a[:2, :2] = 0
    b[2:4, 2:] = 0
    x, y, z = (blocks_of(spark, m, 2, 2) for m in (a, b, c))
    assert np.allclose(dense_of(block.elementwise_product(x, y)), a * b)
    with np.errstate(divide="ignore", invalid="ignore"):
        assert np.allclose(dense_of(block.elementwise_division(x, y)), a / b, equal_nan=True)
    assert np.allclose(dense_of(block.multiply_divide(x, y, z)), a * b / c)
    zero = block.multiply_divide(x, y, x)
    want = np.where(a * b == 0, 0.0, b)
    assert np.allclose(dense_of(zero), want)


def test_division_of_blocks_that_both_lack(spark):
    m = np.ones((4, 4))
    whole = blocks_of(spark, m, 2, 2)
    some = block.BlockMatrix(whole.blocks.where("bi = 0"), whole.grid)
    got = dense_of(block.elementwise_division(some, some))
    assert (got[:2] == 1).all() and np.isnan(got[2:]).all()


def test_many_nearly_empty_blocks_leave_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(block, "HELD_BYTES", 1000)
    m = np.zeros((40, 40))
    m[::10, ::10] = 3.0
    e = entries_of(spark, m)
    assert np.array_equal(dense_of(block.to_blocks(e, 10, 10, 40, 40)), m)


def test_elementwise_needs_one_grid(spark):
    m = np.ones((4, 4))
    with pytest.raises(ValueError, match="block sizes"):
        block.elementwise_product(blocks_of(spark, m, 2, 2), blocks_of(spark, m, 2, 4))


def test_validate_finds_each_fault(spark):
    good = blocks_of(spark, np.ones((5, 4)), 2, 2)
    assert block.validate(good).count() == 0
    b = good.blocks
    one = b.where("bi = 0 and bj = 0")
    broken = (
        b.unionAll(one)
        .unionAll(one.withColumn("bi", F.lit(9)))
        .where("not (bi = 1 and bj = 1)")
        .unionAll(one.withColumn("bi", F.lit(1)).withColumn("bj", F.lit(1)).withColumn("nr", F.lit(1)))
        .unionAll(one.withColumn("bi", F.lit(-1)))
    )
    got = sorted(tuple(r) for r in block.validate(block.BlockMatrix(broken, good.grid)).collect())
    assert got == [
        ("block outside the grid", -1, 0, 1),
        ("block outside the grid", 9, 0, 1),
        ("duplicate block", 0, 0, 2),
        ("wrong block size", 1, 1, 4),
    ]


def test_keyed_blocks_and_profile(spark):
    b = blocks_of(spark, np.ones((5, 4)), 2, 2)
    rebuilt = block.from_keyed_blocks(b.blocks, 2, 2)
    assert rebuilt.grid == b.grid
    assert tuple(block.profile(rebuilt).first()) == (5, 4, 3, 2, 1, 2, 20)


def test_random_blocks(spark):
    grid = block.Grid(7, 5, 3, 2)
    m = dense_of(block.random_blocks(spark, grid, 4))
    assert m.min() >= 0 and m.max() < 1 and len(np.unique(m)) == 35
    other = dense_of(block.random_blocks(spark, block.Grid(7, 5, 7, 5), 4))
    assert np.array_equal(m, other)


def test_tiles_keep_neighbours_together(spark):
    b = blocks_of(spark, np.ones((12, 12)), 2, 2)
    sides = block.tile_sides(b.grid, 4)
    assert sides == (3, 3)
    for r in b.blocks.select("bi", "bj", block.tile_number(b.grid, sides).alias("t")).collect():
        assert r["t"] == r["bi"] // 3 + r["bj"] // 3 * 2
    assert block.tile_sides(block.Grid(10, 3, 1, 1), 9) == (math.floor(10 / 3 + 0.5), 1)
    assert block.tile_sides(block.Grid(1, 1, 1, 1), 100) == (1, 1)
    with pytest.raises(ValueError):
        block.tile_sides(b.grid, 0)


def test_block_grid(spark):
    got = {tuple(r) for r in block.block_grid(spark, 3, 2).collect()}
    assert got == {(i, j) for i in range(3) for j in range(2)}
    assert block.block_grid(spark, 0, 0).count() == 0


def test_unique_entries_skip_the_sum(spark):
    m = RNG.normal(size=(7, 5))
    b = block.to_blocks(entries_of(spark, m), 3, 2, 7, 5, unique=True)
    assert np.array_equal(dense_of(b), m)
    twice = block.to_blocks(entries_of(spark, m).unionAll(entries_of(spark, m)), 3, 2, 7, 5, unique=True)
    assert np.array_equal(dense_of(twice), 2 * m)
