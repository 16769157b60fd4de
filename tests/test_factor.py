import numpy as np
import pytest
from pyspark.errors import PySparkException

from blockweave.operators import factor
from tests.conftest import entries_of, factor_of, matrix_of, matrix_of_factor

RNG = np.random.default_rng(8)
RANKS = [1, 3, 12, 13, 32, 33, 70]


@pytest.mark.parametrize("rank", RANKS)
def test_gram_and_its_product(spark, rank):
    f = RNG.random((25, rank))
    df = factor_of(spark, f)
    g = factor.gram_matrix(df, rank)
    assert np.allclose(g, f.T @ f)
    assert np.allclose(matrix_of_factor(factor.apply_gram(df, g), 25), f @ (f.T @ f))


@pytest.mark.parametrize("rank", RANKS)
def test_entries_and_back(spark, rank):
    f = RNG.random((9, rank)) * (RNG.random((9, rank)) < 0.7)
    f[:, 0] = 1.0
    df = factor.from_entries(entries_of(spark, f), rank)
    assert np.array_equal(matrix_of_factor(df, 9), f)
    assert np.array_equal(matrix_of(factor.to_entries(df), f.shape), f)


@pytest.mark.parametrize("rank", RANKS)
def test_weighted_sums(spark, rank):
    f, v = RNG.random((40, rank)), RNG.random(40)
    rows = [(n % 6, float(v[n]), [float(x) for x in f[n]]) for n in range(40)]
    df = spark.createDataFrame(rows, "id bigint, v double, f array<double>").repartition(3)
    want = np.zeros((6, rank))
    for n in range(40):
        want[n % 6] += v[n] * f[n]
    assert np.allclose(matrix_of_factor(factor.weighted_sums(df, rank), 6), want)


@pytest.mark.parametrize("rank", [2, 20])
def test_update_with_missing_and_zero_rows(spark, rank):
    f, x = RNG.random((7, rank)), RNG.random((7, rank))
    f[3] = 0.0
    x[5] = 0.0
    g = RNG.random((rank, rank))
    g = g + g.T
    projected = factor_of(spark, x).where("id <> 5")
    got = matrix_of_factor(factor.update(factor_of(spark, f), projected, g), 7)
    want = np.divide(f * x, f @ g, out=np.zeros_like(f), where=f * x != 0)
    assert np.allclose(got, want)
    assert not np.isnan(got).any()


def test_random_factor_does_not_depend_on_partitions(spark):
    a = matrix_of_factor(factor.random_factor(spark.range(50), 4, 9), 50)
    b = matrix_of_factor(factor.random_factor(spark.range(50).repartition(7), 4, 9), 50)
    assert np.array_equal(a, b)
    assert a.min() >= 0 and a.max() < 1 and len(np.unique(a)) == a.size


def test_generated_code_compiles(spark):
    """The largest rank of the column path stays within whole-stage code generation."""
    rank = factor.SMALL_RANK
    df = factor_of(spark, RNG.random((5, rank)))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        factor.gram(df, rank).collect()
        rows = df.selectExpr("id", "2D as v", "f")
        factor.weighted_sums(rows, rank).collect()
        wide = factor_of(spark, RNG.random((5, factor.CHUNK))).selectExpr("id", "2D as v", "f")
        factor.weighted_sums(wide, factor.CHUNK).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


@pytest.mark.parametrize("rank", [2, 20])
def test_gram_of_nothing_is_zero(spark, rank):
    empty = spark.createDataFrame([], "id bigint, f array<double>")
    assert factor.gram(empty, rank).collect()[0]["g"] == [0.0] * (rank * rank)


def test_columns_and_rows_of_another_length_stop_the_job(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 9, 2.0)], "i bigint, j bigint, v double")
    for rank in (8, 9):
        with pytest.raises(PySparkException, match="outside"):
            factor.from_entries(cells, rank).collect()
    assert factor.from_entries(cells, 10).count() == 2
    rows = spark.createDataFrame([(0, 1.0, [1.0, 2.0, 3.0])], "id bigint, v double, f array<double>")
    with pytest.raises(PySparkException, match="expected factor rows"):
        factor.weighted_sums(rows, 2).collect()
    with pytest.raises(PySparkException, match="expected factor rows"):
        factor.gram(rows.select("id", "f"), 2).collect()
