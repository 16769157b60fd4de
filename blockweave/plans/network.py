"""The feed-forward classifier as joins and sums over tables.

Activations are entries ``(i = sample, j = unit, v)``; weights are a table
``(layer, out, in, w)`` where ``in = -1`` is the bias. A constant input with index -1 is added to
every sample, so the bias is an ordinary weight in each product and each gradient.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockweave.functions.columns import hash_uniform, sigmoid, sigmoid_slope
from blockweave.functions.kernels import weight_count
from blockweave.operators import entry

BIAS = -1


def check_layers(layers: list[int]) -> list[int]:
    if len(layers) < 2 or min(layers) < 1:
        raise ValueError("need at least an input and an output layer, each with one unit or more")
    return list(layers)


def topology_layout(spark: SparkSession, layers: list[int]) -> DataFrame:
    """One row per affine layer: ``(layer, n_in, n_out, size, first)``, first = place in the vector."""
    rows, first = [], 0
    for level, (n_in, n_out) in enumerate(
        zip(check_layers(layers), layers[1:], strict=False), start=1
    ):
        size = n_in * n_out + n_out
        rows.append((level, n_in, n_out, size, first))
        first += size
    return spark.createDataFrame(rows, "layer int, n_in bigint, n_out bigint, size bigint, first bigint")


def weight_cells(spark: SparkSession, layers: list[int]) -> DataFrame:
    """Every place of the weight vector: ``(pos, layer, n_in, out, in)``."""
    spans = [
        F.struct(F.lit(level).alias("layer"), F.lit(n_in).alias("n_in"), F.lit(n_out).alias("n_out"),
                 F.lit(first).cast("bigint").alias("first"))
        for level, n_in, n_out, _, first in _spans(layers)
    ]
    count = weight_count(layers)
    own = F.element_at(F.filter(F.array(*spans), lambda s: s["first"] <= F.col("pos")), -1)
    at = F.col("pos") - F.col("s.first")
    unit = (at % F.col("s.n_out")).cast("bigint")
    source = F.floor(at / F.col("s.n_out")).cast("bigint")
    return (
        spark.range(count)
        .select(F.col("id").alias("pos"))
        .withColumn("s", own)
        .select(
            "pos",
            F.col("s.layer").alias("layer"),
            F.col("s.n_in").cast("bigint").alias("n_in"),
            unit.alias("out"),
            F.when(source == F.col("s.n_in"), F.lit(BIAS)).otherwise(source).cast("bigint").alias("in"),
        )
    )


def _spans(layers: list[int]):
    first = 0
    for level, (n_in, n_out) in enumerate(zip(layers, layers[1:], strict=False), start=1):
        size = n_in * n_out + n_out
        yield level, n_in, n_out, size, first
        first += size


def initial_weights(
    spark: SparkSession, layers: list[int], seed: int = 11, uniform: Callable[..., Column] = hash_uniform
) -> DataFrame:
    """Weights and biases uniform in ±2.4/sqrt(n_in), as a weights table with ``pos``."""
    unit = uniform(F.col("pos"), seed=seed)
    return weight_cells(spark, check_layers(layers)).select(
        "pos", "layer", "out", "in", ((unit * 4.8 - 2.4) / F.sqrt("n_in")).alias("w")
    )


def weights_table(spark: SparkSession, weights: np.ndarray, layers: list[int]) -> DataFrame:
    """A flat weight vector as rows ``(layer, out, in, w)``."""
    columns: dict[str, list[np.ndarray]] = {"layer": [], "out": [], "in": []}
    for level, n_in, n_out, size, _ in _spans(layers):
        at = np.arange(size)
        source = at // n_out
        columns["layer"].append(np.full(size, level, dtype=np.int32))
        columns["out"].append(at % n_out)
        columns["in"].append(np.where(source == n_in, BIAS, source))
    table = pa.table({k: np.concatenate(v) for k, v in columns.items()} | {"w": weights})
    return spark.createDataFrame(table)


def weights_vector(table: DataFrame, layers: list[int]) -> np.ndarray:
    """A weights table as the flat vector; for models that fit on the driver."""
    flat = np.full(weight_count(layers), np.nan)
    spans = {level: (n_in, n_out, first) for level, n_in, n_out, _, first in _spans(layers)}
    rows = table.select("layer", "out", "in", "w").toArrow()
    for level, (n_in, n_out, first) in spans.items():
        mine = rows.filter(pa.compute.equal(rows["layer"], level))
        source = mine["in"].to_numpy()
        source = np.where(source == BIAS, n_in, source)
        flat[first + source * n_out + mine["out"].to_numpy()] = mine["w"].to_numpy()
    if np.isnan(flat).any():
        raise ValueError("the weights table does not cover the network")
    return flat


def layer_matrix(weights: DataFrame, level: int) -> DataFrame:
    """Weights of a layer as entries ``(i = in, j = out, v)``, bias row included."""
    return weights.where(F.col("layer") == level).select(
        F.col("in").cast("bigint").alias("i"), F.col("out").cast("bigint").alias("j"),
        F.col("w").alias("v"),
    )


def feature_entries(
    samples: DataFrame, key: str, features: str = "features", width: int | None = None
) -> DataFrame:
    """Array features as entries, with the constant input -1 in every sample.

    Features that are not ``width`` values long stop the job.

    Whole samples are hash-partitioned before they are taken apart, so the sums, windows and joins
    by sample that follow need no further exchange.
    """
    x = F.col(features)
    if width is not None:
        message = F.concat(F.lit(f"expected {width} features but got "), F.coalesce(F.size(x).cast("string"), F.lit("null")))
        x = F.when(F.size(x) == width, x).otherwise(F.raise_error(message).cast(samples.schema[features].dataType))
    rows = samples.select(F.col(key).cast("bigint").alias("i"), x.alias("x"))
    values = F.concat(F.col("x").cast("array<double>"), F.array(F.lit(1.0)))
    cells = rows.repartition("i").select("i", F.size("x").alias("n"), F.posexplode(values).alias("pos", "v"))
    unit = F.when(F.col("pos") == F.col("n"), BIAS).otherwise(F.col("pos"))
    return cells.select("i", unit.cast("bigint").alias("j"), "v")


def with_constant(activations: DataFrame) -> DataFrame:
    """Add the constant input -1 next to unit 0 of every sample."""
    own = F.struct("j", "v")
    constant = F.struct(F.lit(BIAS).cast("bigint").alias("j"), F.lit(1.0).alias("v"))
    both = F.when(F.col("j") == 0, F.array(own, constant)).otherwise(F.array(own))
    return activations.select("i", F.explode(both).alias("e")).select("i", "e.j", "e.v")


def affine(inputs: DataFrame, matrix: DataFrame, n_in: int, n_out: int) -> DataFrame:
    """W·x + b for every sample; ``inputs`` carry the constant input."""
    return entry.multiply(inputs, matrix, b_cells=(n_in + 1) * n_out)


def activate(scores: DataFrame) -> DataFrame:
    return scores.withColumn("v", sigmoid(F.col("v")))


def softmax(scores: DataFrame) -> DataFrame:
    """``(i, j, v = raw score, p = probability, lp = log probability)`` within each sample."""
    sample = Window.partitionBy("i")
    shifted = scores.withColumn("s", F.col("v") - F.max("v").over(sample))
    summed = shifted.withColumn("total", F.sum(F.exp("s")).over(sample))
    return summed.select(
        "i", "j", "v", (F.exp("s") / F.col("total")).alias("p"), (F.col("s") - F.ln("total")).alias("lp")
    )


def forward(
    inputs: DataFrame, weights: DataFrame, layers: list[int], hold: Callable = lambda df: df
) -> list[DataFrame]:
    """Inputs of every affine layer (constant included), then the raw scores of the last one."""
    chain = [inputs]
    for level, n_in, n_out, _, _ in _spans(layers):
        scores = affine(chain[-1], layer_matrix(weights, level), n_in, n_out)
        last = level == len(layers) - 1
        chain.append(hold(scores if last else with_constant(activate(scores))))
    return chain


@dataclass(frozen=True)
class Pass:
    """Results of one backward pass: per-sample losses, deltas and gradients by layer."""

    losses: DataFrame
    deltas: dict[int, DataFrame]
    gradient: DataFrame


def backward(
    chain: list[DataFrame],
    targets: DataFrame,
    weights: DataFrame,
    layers: list[int],
    hold: Callable = lambda df: df,
) -> Pass:
    """Cross-entropy loss, deltas and gradient sums of a forward chain.

    ``targets`` is ``(i, label, share)``; a label outside the classes stops the job. A delta is already scaled by its sample's share, so the
    gradient is a plain sum and can be divided by any total.
    """
    place = F.col("label").cast("bigint")
    message = F.concat(F.lit("label out of range: "), F.coalesce(F.col("label").cast("string"), F.lit("null")))
    good = (place >= 0) & (place < layers[-1])
    targets = targets.withColumn("label", F.when(good, place).otherwise(F.raise_error(message).cast("bigint")))
    hit = (F.col("j") == F.col("label").cast("bigint")).cast("double")
    top = softmax(chain[-1]).join(targets, "i")
    losses = top.where(F.col("j") == F.col("label").cast("bigint")).select(
        "i", (-F.col("lp") * F.col("share")).alias("loss"), "share"
    )
    spans = {level: (n_in, n_out) for level, n_in, n_out, _, _ in _spans(layers)}
    deltas, gradients = {}, []
    delta = hold(top.select("i", "j", ((F.col("p") - hit) * F.col("share")).alias("v")))
    for level in range(len(layers) - 1, 0, -1):
        deltas[level] = delta
        n_in, n_out = spans[level]
        # The inner index is the sample: no index holds more entries than a layer has units.
        product = entry.multiply(entry.transpose(delta), chain[level - 1], hot=None)
        gradients.append(
            product.select(
                F.lit(level).alias("layer"), F.col("i").alias("out"), F.col("j").alias("in"),
                F.col("v").alias("g"),
            )
        )
        if level > 1:
            back = layer_matrix(weights, level).where(F.col("i") != BIAS)
            pulled = entry.multiply(delta, entry.transpose(back), b_cells=n_in * n_out)
            slope = chain[level - 1].where(F.col("j") != BIAS)
            delta = hold(_scaled(pulled, slope.withColumn("v", sigmoid_slope(F.col("v")))))
    total = gradients[0]
    for other in gradients[1:]:
        total = total.unionAll(other)
    return Pass(losses, deltas, total)


def _scaled(values: DataFrame, factors: DataFrame) -> DataFrame:
    """Product cell by cell of two tables that are both partitioned by sample.

    A union and a sum keep that partitioning; a join on (sample, unit) would shuffle both sides.
    """
    nothing = F.lit(None).cast("double")
    both = values.select("i", "j", "v", nothing.alias("s")).unionAll(
        factors.select("i", "j", nothing.alias("v"), F.col("v").alias("s"))
    )
    product = F.coalesce(F.sum("v"), F.lit(0.0)) * F.max("s")
    return both.groupBy("i", "j").agg(product.alias("v"))


def argmax_class(scores: DataFrame, value: str = "v") -> DataFrame:
    """``(i, prediction)``: the unit with the largest value, the first one on a tie."""
    best: Column = F.max_by(F.struct((-F.col("j")).alias("k")), F.struct(F.col(value), -F.col("j")))
    return scores.groupBy("i").agg(best.alias("b")).select(
        "i", (-F.col("b.k")).cast("double").alias("prediction")
    )


def weight_change(before: DataFrame, after: DataFrame, tol: float) -> DataFrame:
    """One row ``(change, size, converged)``: ‖after − before‖ < tol · max(‖after‖, 1)."""
    keys = ["layer", "out", "in"]
    pairs = before.select(*keys, F.col("w").alias("a")).join(
        after.select(*keys, F.col("w").alias("b")), keys
    )
    gap = F.col("a") - F.col("b")
    sums = pairs.agg(
        F.sqrt(F.sum(gap * gap)).alias("change"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("size")
    )
    limit = F.lit(tol) * F.greatest("size", F.lit(1.0))
    return sums.withColumn("converged", F.col("change") < limit)
