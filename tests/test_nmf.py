import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.operators import block, factor, tiled
from blockweave.plans import nmf, report
from tests.conftest import entries_of, factor_of, matrix_of_factor

RNG = np.random.default_rng(12)


def ratings(rows=14, cols=9):
    a = RNG.integers(1, 6, size=(rows, cols)) * (RNG.random((rows, cols)) < 0.5).astype(float)
    a[0] = 0.0  # ids may start at 1
    a[:, 0] = 0.0
    a[-1, -1] = 3.0
    return a


def one_pass(a, w, h):
    def step(f, x, g):
        p = f * x
        return np.divide(p, f @ g, out=np.zeros_like(p), where=p != 0)

    h = step(h, a.T @ w, w.T @ w)
    return step(w, a @ h, h.T @ h), h


@pytest.mark.parametrize("rank", [3, 15])
@pytest.mark.parametrize("hot", [None, 3])
def test_fit_against_numpy(spark, rank, hot):
    a = ratings()
    w, h = RNG.random((14, rank)), RNG.random((9, rank))
    got = nmf.fit(
        entries_of(spark, a), rank, 2, w=factor_of(spark, w), h=factor_of(spark, h), hot=hot,
        track_objective=True,
    )
    for error in got.objectives:
        w, h = one_pass(a, w, h)
        assert error == pytest.approx(((a - w @ h.T) ** 2).sum())
    assert np.allclose(matrix_of_factor(got.w, 14), w)
    assert np.allclose(matrix_of_factor(got.h, 9), h)
    assert (got.rows, got.cols) == (14, 9)


def test_objective_never_rises_and_factors_stay_positive(spark):
    got = nmf.fit(entries_of(spark, ratings(20, 12)), 4, 4, track_objective=True)
    errors = got.objectives
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:], strict=False))
    w, h = matrix_of_factor(got.w, 20), matrix_of_factor(got.h, 12)
    assert w.min() >= 0 and h.min() >= 0
    assert not w[0].any() and not h[0].any()


def test_result_does_not_depend_on_partitions(spark):
    e = entries_of(spark, ratings())
    a = nmf.fit(e, 3, 1, seed=5, partitions=2)
    b = nmf.fit(e.repartition(5), 3, 1, seed=5, partitions=7)
    assert np.allclose(matrix_of_factor(a.w, 14), matrix_of_factor(b.w, 14))


def test_hot_keys_are_found_and_kept_apart(spark):
    a = np.zeros((30, 6))
    a[:, 2] = 1.0
    a[4, :] = 2.0
    layout = nmf.Ratings(entries_of(spark, a), hot=5)
    assert layout.by_col.hot_keys == [2]
    assert layout.by_row.hot_keys == [4]
    w = RNG.random((30, 2))
    x = matrix_of_factor(layout.by_row.project(factor_of(spark, w), 2), 6)
    assert np.allclose(x, a.T @ w)
    layout.release()


def test_plan_of_a_pass_reuses_the_layout(spark):
    """The cells stay where they lie: no exchange above the cached tiles, for either update."""
    layout = nmf.Ratings(entries_of(spark, ratings()))
    w, h = factor.random_factor(spark.range(14), 2, 1), factor.random_factor(spark.range(9), 2, 1)
    for rows, side in ((w, layout.by_row), (h, layout.by_col)):
        plan = side.project(rows, 2)._jdf.queryExecution().executedPlan().toString()
        top = plan.split("InMemoryRelation")[0]
        group = top.index("FlatMapCoGroupsInArrow")
        # One exchange, for the sums by id; the factor's side has its own below the group.
        assert top[:group].count("Exchange") == 1
        assert "Exchange" not in top[group : top.index("InMemoryTableScan")]
    layout.release()


def shuffled(side, rows, rank=2):
    """Rows that the two exchanges of a projection carry: routed factor rows, and sums of tiles."""
    return side.routed(rows).count() + side.partial_sums(rows, rank).count()


def test_shuffled_rows_grow_with_the_root_of_the_partitions(spark):
    dense = np.ones((120, 120))
    cells = entries_of(spark, dense)
    w = factor.random_factor(spark.range(120), 2, 1)
    carried = {}
    for parts in (2, 8, 32):
        layout = nmf.Ratings(cells, partitions=parts)
        side = layout.by_row
        tiling = layout.tiled.tiling
        # the tile of a cell is O20's: neighbouring groups share it
        assert tiling.sides == block.tile_sides(tiling.grid, tiled.TILES_PER_PARTITION * parts)
        carried[parts] = shuffled(side, w)
        assert carried[parts] == 120 * (tiling.across + tiling.down)
        assert np.allclose(matrix_of_factor(side.project(w, 2), 120), dense @ matrix_of_factor(w, 120))
        layout.release()
    for few, many in ((2, 8), (8, 32)):
        assert carried[many] <= 2.5 * carried[few]  # four times the partitions
    assert carried[32] <= 120 * 32 / 2  # a layout by one index sends up to 120 x 32 sums


def test_tiles_follow_the_shape_and_the_hot_ids_are_spread(spark):
    tall = tiled.choose_tiling(10**6, 10, 10**6, 50)
    assert tall.across == 1 and 80 <= tall.down <= 120
    assert tiled.choose_tiling(5, 5, 10**9, 2).tiles >= 20
    assert tiled.choose_tiling(0, 0, 0, 4).tiles >= 1
    a = np.zeros((400, 400))
    a[7] = 1.0
    a[:, 9] = 1.0
    layout = nmf.Ratings(entries_of(spark, a), hot=100, partitions=8)
    sizes = [r["c"] for r in layout.tiled.packs.groupBy("tile").agg(F.sum("n").alias("c")).collect()]
    assert sum(sizes) == 799 and max(sizes) < 799 / 4
    h = RNG.random((400, 3))
    assert np.allclose(matrix_of_factor(layout.by_col.project(factor_of(spark, h), 3), 400), a @ h)
    layout.release()


def test_a_stopped_fit_goes_on(spark, tmp_path):
    e, folder = entries_of(spark, ratings()), str(tmp_path / "passes")
    whole = nmf.fit(e, 3, 3, track_objective=True)
    first = nmf.fit(e, 3, 1, track_objective=True, record=folder)
    assert first.objectives == pytest.approx(whole.objectives[:1])
    later = nmf.fit(e, 3, 3, track_objective=True, record=folder)
    assert later.objectives == pytest.approx(whole.objectives)
    assert np.allclose(matrix_of_factor(later.w, 14), matrix_of_factor(whole.w, 14))
    assert np.allclose(matrix_of_factor(later.h, 9), matrix_of_factor(whole.h, 9))
    # two places, whatever the number of passes
    assert sorted(p.name for p in (tmp_path / "passes").iterdir()) == ["place-0", "place-1"]
    with pytest.raises(ValueError, match="holds a fit with rank"):
        nmf.fit(e, 4, 3, record=folder)
    with pytest.raises(ValueError, match="holds a fit with square"):
        nmf.fit(e.withColumn("v", F.col("v") * 2), 3, 3, record=folder)


def test_a_pass_without_its_record_is_done_again(spark, tmp_path, monkeypatch):
    e, folder = entries_of(spark, ratings()), str(tmp_path / "passes")
    whole = nmf.fit(e, 3, 2)
    nmf.fit(e, 3, 1, record=folder)

    def lost(self, iteration, objectives):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(nmf.PassRecord, "finish", lost)
        with pytest.raises(RuntimeError):
            nmf.fit(e, 3, 2, record=folder)
    got = nmf.fit(e, 3, 2, record=folder)
    assert np.allclose(matrix_of_factor(got.w, 14), matrix_of_factor(whole.w, 14))


def test_far_ids_give_the_same_factors(spark):
    a = ratings()[1:, 1:]  # every id has ratings
    a[:, 0] = a[0] = 1.0
    e = entries_of(spark, a)
    near = nmf.fit(e, 3, 2, ids="occurring")
    far = nmf.fit(e.select((F.col("i") * 10**12 + 3).alias("i"), (F.col("j") * 10**9).alias("j"), "v"), 3, 2, ids="occurring")
    back = {(r["id"] - 3) // 10**12: r["f"] for r in far.w.collect()}
    assert {r["id"]: pytest.approx(r["f"]) for r in near.w.collect()} == back
    assert far.h.count() == a.shape[1]
    with pytest.raises(ValueError, match="ids must be"):
        nmf.fit(e, 3, 1, ids="some")


def test_no_iterations_and_no_ratings(spark):
    got = nmf.fit(entries_of(spark, ratings()), 2, 0)
    assert got.w.count() == 14 and got.h.count() == 9
    empty = spark.createDataFrame([], "i bigint, j bigint, v double")
    got = nmf.fit(empty, 2, 1)
    assert (got.rows, got.cols, got.w.count(), got.h.count()) == (0, 0, 0, 0)


def test_bad_arguments(spark):
    e = entries_of(spark, ratings())
    with pytest.raises(ValueError):
        nmf.fit(e, 0, 1)
    with pytest.raises(ValueError):
        nmf.fit(e, 1, -1)


def test_summary(spark):
    e = entries_of(spark, ratings())
    got = {r["matrix"]: r for r in report.fit_summary(e, nmf.fit(e, 3, 1), 4, 4).collect()}
    assert (got["A"]["rows"], got["A"]["cols"]) == (14, 9)
    assert (got["W"]["rows"], got["W"]["cols"], got["W"]["stored"]) == (14, 3, 42)
    assert (got["H"]["rows"], got["H"]["cols"], got["H"]["row_blocks"]) == (3, 9, 1)


@pytest.mark.parametrize("cell", [(None, 0, 1.0), (0, None, 1.0), (-1, 0, 1.0), (0, -2, 1.0), (0, 0, None)])
def test_ratings_without_a_place_or_value_stop_the_fit(spark, cell):
    e = spark.createDataFrame([(1, 1, 2.0), cell], "i bigint, j bigint, v double")
    with pytest.raises(ValueError, match="ratings have"):
        nmf.fit(e, 2, 1)


def test_a_supplied_factor_must_cover_the_ratings(spark):
    e = spark.createDataFrame([(1, 1, 2.0), (5, 1, 2.0)], "i bigint, j bigint, v double")
    with pytest.raises(ValueError, match="no row for i"):
        nmf.fit(e, 2, 1, w=factor_of(spark, RNG.random((3, 2))))


def test_rows_of_many_hot_ids_go_only_where_their_cells_are(spark):
    a = np.zeros((60, 40))
    for i in range(60):
        a[i, [(i * 7 + k * 11) % 40 for k in range(4)]] = 1.0 + i
    layout = nmf.Ratings(entries_of(spark, a), hot=2, partitions=32)
    w = RNG.random((60, 3))
    assert len(layout.by_row.hot_keys) == 60 and layout.tiled.tiling.tiles > 40
    assert layout.by_row.routed(factor_of(spark, w)).count() <= np.count_nonzero(a)
    assert np.allclose(matrix_of_factor(layout.by_row.project(factor_of(spark, w), 3), 40), a.T @ w)
    layout.release()


def test_tiles_follow_the_cells_and_not_the_sessions_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        layout = nmf.Ratings(entries_of(spark, np.ones((30, 30))))
        assert layout.tiled.tiling.tiles <= 4 * spark.sparkContext.defaultParallelism
        layout.release()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_start_factors_may_be_made_from_the_ids(spark):
    e = entries_of(spark, ratings())
    start = factor.random_factor(spark.range(14), 3, 1), factor.random_factor(spark.range(9), 3, 2)
    given = nmf.fit(e, 3, 1, w=start[0], h=start[1])
    made = nmf.fit(e, 3, 1, w=lambda ids: factor.random_factor(ids, 3, 1), h=lambda ids: factor.random_factor(ids, 3, 2))
    assert np.allclose(matrix_of_factor(given.w, 14), matrix_of_factor(made.w, 14))
