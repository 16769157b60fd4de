import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockweave.operators import entry
from tests.conftest import entries_of, matrix_of

RNG = np.random.default_rng(5)


def sparse(rows, cols, density=0.4):
    return RNG.normal(size=(rows, cols)) * (RNG.random((rows, cols)) < density)


def test_to_entries_and_duplicates(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 4), (0, 5, 1)], "u int, m int, r int")
    got = entry.sum_duplicates(entry.to_entries(df, "u", "m", F.col("r") * 2))
    assert sorted(map(tuple, got.collect())) == [(0, 5, 2.0), (1, 2, 14.0)]
    assert got.dtypes == [("i", "bigint"), ("j", "bigint"), ("v", "double")]
    assert tuple(entry.matrix_shape(got).first()) == (2, 6)


def test_empty_matrix(spark):
    empty = spark.createDataFrame([], "i bigint, j bigint, v double")
    assert tuple(entry.matrix_shape(empty).first()) == (0, 0)
    assert tuple(entry.matrix_profile(empty, 4, 4).first()) == (0, 0, 0, 0, 0, 0, 0)
    assert entry.multiply(empty, empty).count() == 0
    assert entry.to_dense(empty, 2, 2).count() == 4
    assert entry.to_dense(empty, 0, 0).count() == 0


def test_profile(spark):
    got = entry.matrix_profile(entries_of(spark, np.eye(10)), 4, 3).first().asDict()
    assert got == {
        "rows": 10, "cols": 10, "row_blocks": 3, "col_blocks": 4,
        "block_rows": 3, "block_cols": 2, "stored": 10,
    }


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"hot": None}, {"b_cells": 50}, {"a_cells": 50}])
def test_multiply_by_every_strategy(spark, options):
    a, b = sparse(9, 12), sparse(12, 7)
    a[:, 4] = 1.5  # one inner index with more entries than the others on both sides
    b[4, :] = -2.0
    got = entry.multiply(entries_of(spark, a), entries_of(spark, b), **options)
    assert np.allclose(matrix_of(got, (9, 7)), a @ b)


def test_a_hot_inner_index_is_spread_over_tasks(spark):
    a = spark.range(3000).select(F.col("id").alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(1.0).alias("v"))
    b = spark.range(3).select(F.lit(0).cast("bigint").alias("i"), F.col("id").alias("j"), F.lit(2.0).alias("v"))
    keys = entry._hot_inner_keys(a, b, 100).collect()
    assert [tuple(k) for k in keys] == [(0, 30, 1)]
    assert [tuple(k) for k in entry._hot_inner_keys(a, b, 500).collect()] == [(0, 6, 1)]
    got = entry.multiply(a, b, hot=100)
    assert got.agg(F.count("*"), F.sum("v")).first()[:] == (9000, 18000.0)


def test_hot_keys_are_split_by_pairs_and_without_a_cap(spark):
    """No salt of a key has more than the wanted pairs, however many keys are hot."""
    a = spark.range(40_000).select(F.col("id").alias("i"), (F.col("id") % 2).alias("j"), F.lit(1.0).alias("v"))
    b = a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    for key, sa, sb in entry._hot_inner_keys(a, b, 1_000_000, 10_000_000).collect():
        assert key in (0, 1) and 20_000 / sa * 20_000 / sb <= 10_000_000
    many = spark.range(60_000).select(F.col("id").alias("i"), (F.col("id") % 20_000).alias("j"), F.lit(1.0).alias("v"))
    assert entry._hot_inner_keys(many, b.limit(0), 2).count() == 20_000


def test_transpose_of_a_product(spark):
    a, b = sparse(5, 6), sparse(6, 4)
    ea, eb = entries_of(spark, a), entries_of(spark, b)
    left = entry.transpose(entry.multiply(ea, eb))
    right = entry.multiply(entry.transpose(eb), entry.transpose(ea))
    assert np.allclose(matrix_of(left, (4, 5)), matrix_of(right, (4, 5)))


def test_elementwise(spark):
    a, b, c = sparse(6, 5), sparse(6, 5), sparse(6, 5)
    ea, eb, ec = (entries_of(spark, m) for m in (a, b, c))
    assert np.allclose(matrix_of(entry.elementwise_product(ea, eb), a.shape), a * b)
    for r in entry.elementwise_division(ea, eb).collect():
        x, y = a[r["i"], r["j"]], b[r["i"], r["j"]]
        assert r["v"] == (math.copysign(math.inf, x) if y == 0 else x / y)
    for r in entry.multiply_divide(ea, eb, ec).collect():
        p, y = a[r["i"], r["j"]] * b[r["i"], r["j"]], c[r["i"], r["j"]]
        want = 0.0 if p == 0 else math.copysign(math.inf, p) if y == 0 else p / y
        assert r["v"] == pytest.approx(want)


def test_explicit_zero_over_absent_is_nan(spark):
    a = spark.createDataFrame([(0, 0, 0.0)], "i bigint, j bigint, v double")
    assert math.isnan(entry.elementwise_division(a, a.where("v > 1")).first()["v"])


def test_cogroups_keep_every_cell(spark):
    a, b, c = sparse(4, 4), sparse(4, 4), sparse(4, 4)
    got = entry.cogroup3(*(entries_of(spark, m) for m in (a, b, c))).collect()
    assert len(got) == np.count_nonzero((a != 0) | (b != 0) | (c != 0))
    for r in got:
        for name, m in (("a", a), ("b", b), ("c", c)):
            assert (r[name] or 0.0) == m[r["i"], r["j"]]


def test_dense_and_back(spark):
    a = sparse(3, 5)
    dense = entry.to_dense(entries_of(spark, a), 3, 5)
    assert dense.count() == 15
    assert np.allclose(matrix_of(dense, a.shape), a)
    assert entry.to_sparse(dense).count() == np.count_nonzero(a)


def test_gram(spark):
    a = sparse(20, 6)
    assert np.allclose(matrix_of(entry.gram(entries_of(spark, a), 6), (6, 6)), a.T @ a)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cells=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(-4, 4)), max_size=25))
def test_square_of_any_matrix(spark, cells):
    m = np.zeros((6, 6))
    for i, j, v in cells:
        m[i, j] += v
    df = spark.createDataFrame([(i, j, float(v)) for i, j, v in cells], "i bigint, j bigint, v double")
    e = entry.sum_duplicates(df)
    assert np.array_equal(matrix_of(entry.multiply(e, e, hot=4), m.shape), m @ m)


def test_exploded_rows_of_unknown_size_are_not_broadcast(spark):
    """No index is split, so the table of split ones is empty and the side's estimate leaves its explosion out."""
    a = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") % 500).alias("j"), F.lit(1.0).alias("v")).repartition(3)
    ids = spark.range(500).select("id", F.array_repeat(F.lit(2.0), 8).alias("f"))
    b = ids.select(F.col("id").alias("i"), F.posexplode("f").alias("j", "v")).withColumn("j", F.col("j").cast("bigint"))
    for options in ({}, {"hot": None}):
        got = entry.multiply(a, b, **options)
        assert len(got.collect()) == 16_000
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "SortMergeJoin" in plan
        assert "BroadcastHashJoin [j#" not in plan
