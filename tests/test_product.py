import numpy as np
import pyarrow as pa
import pytest

from blockweave.operators import block, product, sparse_block
from tests.conftest import entries_of, matrix_of
from tests.test_block import blocks_of, dense_of

RNG = np.random.default_rng(8)


def sparse_matrix(rows, cols, share=0.2):
    return np.where(RNG.random((rows, cols)) < share, RNG.normal(size=(rows, cols)), 0.0)


def sparse_of(spark, m, r, c, **options):
    return sparse_block.to_sparse_blocks(entries_of(spark, m), r, c, *m.shape, **options)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    text = plan_of(df)
    return sum(line.lstrip(" :+-").startswith("Exchange") for line in text.splitlines())


@pytest.fixture
def no_broadcast(monkeypatch):
    monkeypatch.setattr(block, "BROADCAST_BYTES", 0)


@pytest.mark.parametrize("left,right", [(True, True), (True, False), (False, True), (False, False)])
@pytest.mark.parametrize("shape", [(9, 7, 5), (3, 4, 11), (2, 13, 2)])
def test_products_of_every_kind(spark, no_broadcast, left, right, shape):
    m, k, n = shape
    a, b = sparse_matrix(m, k, 0.4), sparse_matrix(k, n, 0.4)
    x = sparse_of(spark, a, 2, 3) if left else blocks_of(spark, a, 2, 3)
    y = sparse_of(spark, b, 3, 2) if right else blocks_of(spark, b, 3, 2)
    assert np.allclose(dense_of(block.multiply(x, y)), a @ b)


@pytest.mark.parametrize("limit", [None, 0])
def test_one_inner_block(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(block, "BROADCAST_BYTES", limit)
    a, b = sparse_matrix(9, 3, 0.5), RNG.normal(size=(3, 4))
    got = block.multiply(sparse_of(spark, a, 2, 3), blocks_of(spark, b, 3, 2))
    assert np.allclose(dense_of(got), a @ b)
    assert shuffles(got.blocks) >= 2  # those of the inputs
    both = block.multiply(block.transpose(blocks_of(spark, b, 3, 2)), block.transpose(sparse_as_dense(spark, a)))
    assert np.allclose(dense_of(both), b.T @ a.T)


def sparse_as_dense(spark, a):
    return sparse_block.to_dense(sparse_of(spark, a, 2, 3))


def written(spark, matrix, path):
    matrix.blocks.write.parquet(path)
    return block.BlockMatrix(spark.read.parquet(path), matrix.grid, matrix.cells)


def test_one_shuffle_and_no_sum_behind_it(spark, no_broadcast, tmp_path):
    a, b = RNG.normal(size=(24, 20)), RNG.normal(size=(20, 16))
    x = written(spark, blocks_of(spark, a, 4, 5), str(tmp_path / "a"))
    y = written(spark, sparse_of(spark, b, 5, 4), str(tmp_path / "b"))
    got = block.multiply(x, y)
    assert shuffles(got.blocks) == 1 and "Aggregate" not in plan_of(got.blocks)
    assert np.allclose(dense_of(got), a @ b)


def test_slabs_are_added(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(product, "TASK_WORK", 50)
    monkeypatch.setattr(product, "STAGE_BYTES", 0)
    a, b = RNG.normal(size=(4, 60)), RNG.normal(size=(60, 4))
    x, y = blocks_of(spark, a, 4, 3), blocks_of(spark, b, 3, 4)
    layout = block.product_layout(x, y)
    assert layout.slabs > 1
    assert np.allclose(dense_of(block.multiply(x, y)), a @ b)


def layout(row_blocks, inner, col_blocks, tasks, block=1000, held=1 << 27, **sizes):
    cells = block * block
    sizes = {"left_bytes": row_blocks * inner * cells * 8, "right_bytes": inner * col_blocks * cells * 8} | sizes
    return product.choose_layout(
        row_blocks, inner, col_blocks, tasks=tasks, work=float(row_blocks * inner * col_blocks * block**3),
        output_bytes=row_blocks * col_blocks * cells * 8, block_bytes=cells * 8, held=held, **sizes,
    )


def test_layouts():
    # square: tiles of the output alone, shaped like it, within memory
    square = layout(100, 100, 100, 400)
    assert square.slabs == 1 and square.height * square.width * 8_000_000 <= 1 << 27
    # a tall matrix against itself: few output blocks, so the inner dimension is cut
    tall = layout(1, 10_000, 1, 400)
    assert tall.slabs == 400 and tall.down == tall.across == 1
    # more tiles repeat more: the replication of a square product grows with the root of the tiles
    few, many = (layout(400, 400, 400, t, block=10, held=1 << 40) for t in (100, 10_000))
    assert few.across <= many.across <= 10 * max(few.across, 1) + 1
    # a long narrow output is cut along its length
    long = layout(10_000, 10, 1, 400)
    assert long.slabs == 1 and long.across == 1 and 300 <= long.down <= 900
    assert layout(1, 1, 1, 8) == product.Layout(1, 1, 1, 1, 1, 1)
    assert layout(0, 0, 0, 8).slabs == 1


def test_tile_numbers_are_those_of_the_grid(spark):
    grid = block.Grid(12, 12, 2, 2)
    sides = block.tile_sides(grid, 4)
    b = blocks_of(spark, np.ones((12, 12)), 2, 2)
    one = product.Layout(*sides, 2, 2, 1, 6)
    dealt = {(r["bi"], r["bj"]): r["t"] for r in b.blocks.select("bi", "bj", block.tile_number(grid, sides).alias("t")).collect()}
    assert all(t == bi // one.height + bj // one.width * one.down for (bi, bj), t in dealt.items())


def test_sparse_there_and_back(spark):
    m = sparse_matrix(11, 9)
    m[:2, :4] = 0
    s = sparse_of(spark, m, 2, 4)
    assert sparse_block.validate(s).count() == 0
    assert np.array_equal(matrix_of(sparse_block.to_entries(s), m.shape), m)
    t = sparse_block.transpose(s)
    assert np.array_equal(matrix_of(sparse_block.to_entries(t), m.T.shape), m.T)
    assert sparse_block.validate(t).count() == 0
    assert np.array_equal(dense_of(sparse_block.to_dense(s)), m)
    back = sparse_block.to_sparse(blocks_of(spark, m, 2, 4))
    assert sparse_block.validate(back).count() == 0
    assert np.array_equal(matrix_of(sparse_block.to_entries(back), m.shape), m)
    assert sparse_block.is_sparse(back) and not sparse_block.is_sparse(sparse_block.to_dense(back))


def test_sparse_repeats_zeros_and_empty(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (4, 6, 0.0)], "i bigint, j bigint, v double")
    for unique in (False, True):  # repeats are added inside the block too
        s = sparse_block.to_sparse_blocks(df, 2, 3, unique=unique)
        assert sorted(tuple(r) for r in sparse_block.to_entries(s).collect()) == [(1, 1, 5.0), (4, 6, 0.0)]
    none = sparse_block.to_sparse_blocks(df.limit(0), 2, 3, 4, 6)
    assert sparse_block.to_entries(none).collect() == [] and sparse_block.transpose(none).blocks.collect() == []
    assert block.multiply(none, blocks_of(spark, np.ones((6, 2)), 3, 2)).blocks.collect() == []


def test_broken_sparse_blocks_are_named(spark):
    s = sparse_of(spark, np.ones((4, 4)), 2, 2)
    rows = [r.asDict() for r in s.blocks.collect()]
    for r in rows:
        if (r["bi"], r["bj"]) == (0, 0):
            r["starts"] = [0, 3, 2]
        elif (r["bi"], r["bj"]) == (0, 1):
            r["places"] = [0, 1, 0, 2]
        elif (r["bi"], r["bj"]) == (1, 0):
            r["nr"] = 1
    rows.append(dict(rows[0], bi=7, bj=0, starts=[0, 2, 4], places=[0, 1, 0, 1], nr=2))
    bad = block.BlockMatrix(spark.createDataFrame(rows, sparse_block.SCHEMA), s.grid)
    got = {(r["rule"], r["bi"], r["bj"]) for r in sparse_block.validate(bad).collect()}
    assert ("broken columns", 0, 0) in got and ("broken columns", 0, 1) in got
    assert ("wrong block size", 1, 0) in got and ("block outside the grid", 7, 0) in got


def test_a_sparse_product_in_small_pieces(monkeypatch):
    monkeypatch.setattr(product, "PIECE_BYTES", 64)
    a, b = sparse_matrix(9, 7, 0.5), sparse_matrix(7, 6, 0.5)

    def compressed(m):
        pos = np.flatnonzero(m.T.reshape(-1))
        return product.Sparse(m.shape[0], np.searchsorted(pos, np.arange(m.shape[1] + 1) * m.shape[0]), pos % m.shape[0], m.T.reshape(-1)[pos])

    for x in (a, compressed(a)):
        for y in (b, compressed(b)):
            total = np.ones((9, 6), order="F")
            product.add_product(total, x, y)
            assert np.allclose(total, a @ b + 1)


def test_blocks_are_gathered_one_at_a_time_from_small_batches(spark):
    """No row holds a list of cells on the way to Python, and a block may go over many batches."""
    grid = block.Grid(5, 7, 2, 3)
    batch = lambda *rows: pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())],
        ["block", "pos", "v"],
    )
    found = list(block.each_block(iter([batch((0, 1, 1.0)), batch(), batch((0, 3, 2.0), (5, 0, 3.0)), batch((8, 0, 4.0))]), grid))
    assert [f[:4] for f in found] == [(0, 0, 2, 3), (1, 2, 2, 1), (2, 2, 1, 1)]
    assert [f[4].tolist() for f in found] == [[1, 3], [0], [0]]
    assert [f[5].tolist() for f in found] == [[1.0, 2.0], [3.0], [4.0]]
    m = np.arange(35.0).reshape(5, 7)
    for made in (sparse_block.to_sparse_blocks(entries_of(spark, m), 2, 3, 5, 7), block.to_blocks(entries_of(spark, m), 2, 3, 5, 7)):
        assert "collect_list" not in made.blocks._jdf.queryExecution().toString()
