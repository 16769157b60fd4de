"""Column expressions: IEEE division, seeded uniforms, label coding, array arithmetic, activations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MANTISSA = 1 << 53


def divide_ieee(a: Column, b: Column) -> Column:
    """``a / b`` with 0/0 = NaN and x/0 = ±Infinity, also in ANSI mode."""
    at_zero = (
        F.when((a == 0) | F.isnan(a), F.lit(float("nan")))
        .when(a > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def zero_or_ratio(product: Column, denominator: Column) -> Column:
    """``product / denominator``, but zero whenever the product is zero."""
    return F.when(product == 0, F.lit(0.0)).otherwise(divide_ieee(product, denominator))


def hash_uniform(*keys: Column, seed: int) -> Column:
    """A double in [0, 1) that depends only on the keys and the seed."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(_MANTISSA)) / F.lit(float(_MANTISSA))


def one_hot(label: Column, classes: int) -> Column:
    """Zeros with 1.0 at the truncated label; a label outside the range stops the job."""
    position = label.cast("int")
    ok = (position >= 0) & (position < classes)
    vector = F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == position).cast("double")
    )
    message = F.concat(F.lit("label out of range: "), F.coalesce(label.cast("string"), F.lit("null")))
    return F.when(ok, vector).otherwise(F.raise_error(message).cast("array<double>"))


def argmax(values: Column) -> Column:
    """Position of the largest element, the first one on a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("double")


def vector_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def vector_dot(left: Column, right: Column) -> Column:
    return vector_sum(F.zip_with(left, right, lambda p, q: p * q))


def vector_norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))


def axpy(scale: Column | float, x: Column, y: Column) -> Column:
    """``y + scale * x`` over two arrays."""
    factor = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.zip_with(y, x, lambda q, p: q + factor * p)


def vertcat(*parts: Column) -> Column:
    return F.concat(*parts)


def map_matrix(values: Column, function) -> Column:
    """Apply a column function to every element of an array."""
    return F.transform(values, function)


def map_matrices(left: Column, right: Column, function) -> Column:
    """Apply a two-argument column function to the elements of two arrays."""
    return F.zip_with(left, right, function)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sigmoid_slope(z: Column) -> Column:
    """Derivative of the sigmoid, from its output."""
    return (F.lit(1.0) - z) * z


def softmax(scores: Column) -> Column:
    """Softmax of an array of raw scores."""
    shifted = F.transform(scores, lambda u: F.exp(u - F.array_max(scores)))
    return F.transform(shifted, lambda e: e / vector_sum(shifted))
