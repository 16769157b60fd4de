import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.operators import reduce
from blockweave.plans import table_lbfgs

RNG = np.random.default_rng(6)


def table_of(spark, vector, width=3):
    rows = [(n, [float(x) for x in vector[a : a + width]]) for n, a in enumerate(range(0, len(vector), width))]
    return spark.createDataFrame(rows, "slot bigint, v array<double>").repartition(3)


def vector_of(table):
    return np.concatenate([r["v"] for r in sorted(table.collect(), key=lambda r: r["slot"])])


def quadratic(spark, a, b):
    """Half of xᵀAx - bᵀx; a test's cost may go through the driver."""

    def cost(point):
        x = vector_of(point)
        return float(0.5 * x @ a @ x - b @ x), table_of(spark, a @ x - b)

    return cost


def test_finds_the_least_point_of_a_quadratic(spark):
    a, b = np.diag([1.0, 2.0, 3.0, 1.5, 2.5, 1.0, 2.0]) + 0.1, RNG.normal(size=7)
    got, history = table_lbfgs.minimise(table_of(spark, np.zeros(7)), quadratic(spark, a, b), tol=1e-9, corrections=4, iterations=12)
    assert np.allclose(vector_of(got), np.linalg.solve(a, b), atol=1e-3)
    values = [v for _, v in history]
    assert all(x >= y for x, y in zip(values, values[1:], strict=False))


def test_direction_is_that_of_the_vectors():
    moves, slope = RNG.normal(size=(3, 5)), RNG.normal(size=5)
    bends = moves @ np.diag([1.0, 2.0, 3.0, 4.0, 5.0])
    basis = np.vstack([moves, bends, slope])
    got = table_lbfgs.direction_of(basis @ basis.T, 3) @ basis
    from blockweave.plans.training import _inverse_product

    assert np.allclose(got, -_inverse_product(list(zip(moves, bends, strict=True)), slope))
    assert np.allclose(table_lbfgs.direction_of(np.array([[4.0]]), 0), [-1.0])


def test_inner_products_and_missing_slots(spark):
    x, y = RNG.normal(size=8), RNG.normal(size=8)
    both = table_of(spark, x).withColumnRenamed("v", "x").join(table_of(spark, y).withColumnRenamed("v", "y"), "slot")
    assert np.allclose(table_lbfgs.inner_products(both, ["x", "y"]), [[x @ x, x @ y], [x @ y, y @ y]])
    short = both.withColumn("y", F.when(F.col("slot") == 1, F.slice("y", 1, 1)).otherwise(F.col("y")))
    with pytest.raises(Exception, match="missing or of another length"):
        table_lbfgs.inner_products(short, ["x", "y"])
    assert (table_lbfgs.inner_products(both.limit(0), ["x", "y"]) == 0).all()


def test_no_iterations(spark):
    got, history = table_lbfgs.minimise(table_of(spark, np.ones(4)), quadratic(spark, np.eye(4), np.zeros(4)), iterations=0)
    assert vector_of(got).tolist() == [1.0] * 4 and history == [(0, 2.0)]


@pytest.mark.parametrize("direct", [1, 64])
def test_sums_in_slices(spark, monkeypatch, direct):
    monkeypatch.setattr(reduce, "DIRECT_PARTIALS", direct)
    slice_bytes, parts, size = 80, 9, 37

    def partial(batches):
        from blockweave.operators.reduce import partial_rows

        n = sum(b.num_rows for b in batches)
        yield partial_rows(np.arange(size) + float(n), slice_bytes)

    partials = spark.range(0, 90, 1, parts).mapInArrow(partial, reduce.SCHEMA)
    slices = reduce.slice_count(size, slice_bytes)
    assert slices == 4
    rows = reduce.slice_sums(partials, parts, slices).collect()
    assert sorted(r["slice"] for r in rows) == [0, 1, 2, 3]
    total = np.concatenate([np.frombuffer(r["total"]) for r in sorted(rows, key=lambda r: r["slice"])])
    assert np.allclose(total, parts * np.arange(size) + 90)
    # what a final task reads: a slice of every partial sum, not whole vectors
    assert all(len(r["total"]) <= slice_bytes for r in partials.collect())


def test_sum_of_nothing(spark):
    none = spark.createDataFrame([], reduce.SCHEMA)
    assert reduce.tree_sum(none, 1, 5) is None
