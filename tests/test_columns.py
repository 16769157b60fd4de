import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from blockweave.functions import columns as c


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [(6, 3, 2.0), (0, 5, 0.0), (1, 0, math.inf), (-1, 0, -math.inf), (0, 0, math.nan)],
)
def test_divide_ieee(spark, a, b, want):
    df = spark.createDataFrame([(float(a), float(b))], "a double, b double")
    got = df.select(c.divide_ieee(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert got == want or (math.isnan(got) and math.isnan(want))


def test_zero_product_wins_over_zero_denominator(spark):
    assert one(spark, c.zero_or_ratio(F.lit(0.0), F.lit(0.0))) == 0.0
    assert one(spark, c.zero_or_ratio(F.lit(6.0), F.lit(4.0))) == 1.5


def test_one_hot_truncates_and_refuses(spark):
    assert one(spark, c.one_hot(F.lit(2.9), 4)) == [0.0, 0.0, 1.0, 0.0]
    for bad in (F.lit(4.0), F.lit(-1.0), F.lit(None).cast("double")):
        with pytest.raises(PySparkException, match="label out of range"):
            one(spark, c.one_hot(bad, 4))


def test_argmax_takes_first_of_a_tie(spark):
    assert one(spark, c.argmax(arr(1, 5, 5, 2))) == 1.0


def test_array_arithmetic(spark):
    x, y = arr(1, 2, 3), arr(10, 20, 30)
    assert one(spark, c.axpy(2.0, x, y)) == [12.0, 24.0, 36.0]
    assert one(spark, c.vector_sum(x)) == 6.0
    assert one(spark, c.vector_dot(x, y)) == 140.0
    assert one(spark, c.vector_norm(arr(3, 4))) == 5.0
    assert one(spark, c.vertcat(x, y)) == [1.0, 2.0, 3.0, 10.0, 20.0, 30.0]
    assert one(spark, c.map_matrix(x, lambda v: v * v)) == [1.0, 4.0, 9.0]
    assert one(spark, c.map_matrices(x, y, lambda p, q: q - p)) == [9.0, 18.0, 27.0]


def test_activations(spark):
    values = np.array([-800.0, -1.0, 0.0, 3.0])
    got = one(spark, F.transform(arr(*values), c.sigmoid))
    with np.errstate(over="ignore"):
        assert np.allclose(got, 1 / (1 + np.exp(-values)))
    probability = one(spark, c.softmax(arr(1000, 1001, 999)))
    assert abs(sum(probability) - 1) < 1e-12
    assert probability[1] == max(probability)
    assert one(spark, c.sigmoid_slope(F.lit(0.25))) == 0.1875


def test_hash_uniform_is_repeatable_and_in_range(spark):
    draw = c.hash_uniform(F.col("id"), seed=3)
    a = [r[0] for r in spark.range(2000).select(draw).collect()]
    b = [r[0] for r in spark.range(2000).repartition(3).sort("id").select(draw).collect()]
    assert a == b
    assert min(a) >= 0 and max(a) < 1
    assert abs(np.mean(a) - 0.5) < 0.03
    other = [r[0] for r in spark.range(2000).select(c.hash_uniform(F.col("id"), seed=4)).collect()]
    assert a != other
