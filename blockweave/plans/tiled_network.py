"""The classifier for models above the broadcast size: weights, activations and gradients as dense blocks.

Samples lie in groups, the block rows of the input matrix; a layer's weights are a block matrix of (inputs + 1) x
units whose last row is the bias, met by a constant input. A pass is block products (``operators.product``): one
shuffle of blocks each, outer products added inside the tasks, no row for a pair of units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from blockweave.functions import arrow, kernels
from blockweave.operators import block
from blockweave.operators.block import BlockMatrix, Grid
from blockweave.operators.numbering import numbered
from blockweave.operators.product import block_rows
from blockweave.plans import network
from blockweave.session import MAX_BLOCK_CELLS, cut

#: Units along a side of a weight block.
UNIT_BLOCK = 1024
#: One layer's weights and gradient side by side: ``layer, bi, bj, nr, nc, data``.
WEIGHTS = "layer int, bi int, bj int, nr int, nc int, data array<double>"


@dataclass(frozen=True)
class Shape:
    """Layers and the block sizes that follow from them."""

    layers: tuple[int, ...]
    group: int
    unit_block: int = UNIT_BLOCK

    def side(self, level: int) -> int:
        """Units in a block of a layer; all classes lie in one block, so that softmax needs no shuffle."""
        classes = self.layers[-1]
        if level == len(self.layers) - 1:
            return classes
        return max(1, min(self.unit_block, MAX_BLOCK_CELLS // classes, MAX_BLOCK_CELLS // self.group))

    def weights(self, level: int) -> Grid:
        """Grid of the weights into layer ``level`` (from 1)."""
        return Grid(self.layers[level - 1] + 1, self.layers[level], self.side(level - 1), self.side(level))

    def outputs(self, level: int, samples: int, constant: bool) -> Grid:
        return Grid(samples, self.layers[level] + constant, self.group, self.side(level))


@dataclass
class TiledSamples:
    """Packed groups: ``inputs`` blocks with the constant column, and ``bi, labels, shares`` of each group."""

    inputs: DataFrame
    targets: DataFrame
    count: int
    shape: Shape
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def group_size(layers: list[int], wanted: int) -> int:
    """Samples of a group: so many that a group's widest layer is a bounded block."""
    return max(1, min(wanted, MAX_BLOCK_CELLS // (max(layers) + 1)))


def prepare(
    samples: DataFrame, layers: list[int], *, key: str, features: str = "features", label: str = "label",
    share: str | None = None, group: int = 128, averaging: str = "row", unit_block: int = UNIT_BLOCK,
) -> TiledSamples:
    """Pack samples into groups in order of ``key``, a number that each sample has for its own."""
    layers = network.check_layers(layers)
    if averaging not in ("stack", "row"):
        raise ValueError('averaging must be "stack" or "row"')
    if layers[-1] > MAX_BLOCK_CELLS:
        raise ValueError(f"at most {MAX_BLOCK_CELLS} classes")
    fitting = group_size(layers, group)
    if averaging == "stack" and fitting < group:
        raise ValueError(f"a stack of {group} samples exceeds a block; at most {fitting} fit")
    shape = Shape(tuple(layers), fitting, unit_block)
    x, y = F.col(features).cast("array<double>"), F.col(label).cast("double")
    wide = F.concat(F.lit(f"expected {layers[0]} features but got "), F.coalesce(F.size(x).cast("string"), F.lit("null")))
    odd = F.concat(F.lit("label out of range: "), F.coalesce(y.cast("string"), F.lit("null")))
    good = (y >= 0) & (y < layers[-1])
    rows = samples.select(
        F.col(key).cast("bigint").alias("key"),
        F.when(F.size(x) == layers[0], x).otherwise(F.raise_error(wide).cast("array<double>")).alias("x"),
        F.when(good, F.floor(y).cast("int")).otherwise(F.raise_error(odd).cast("int")).alias("label"),
        (F.col(share).cast("double") if share else F.lit(1.0)).alias("share"),
    )
    placed = numbered(rows, "key", name="place")  # written
    facts = placed.agg(F.count("*"), F.count("key"), F.countDistinct("key")).first()
    if facts[0] != facts[1] or facts[1] != facts[2]:
        raise ValueError("every sample needs a key of its own")
    row = F.struct("place", "x", "label", "share")
    packed = placed.groupBy(F.expr(f"cast(place div {shape.group} as int)").alias("bi")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    one = F.lit(1.0) / F.size("rows") if averaging == "stack" else F.lit(1.0)
    groups = packed.select("bi", F.col("rows.x").alias("x"), F.col("rows.label").alias("labels"),
                           F.transform("rows.share", lambda s: s * one).alias("shares")).persist(StorageLevel.MEMORY_AND_DISK)
    width = shape.side(0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, lists in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = arrow.to_matrix(lists.values)
                whole = np.concatenate([values, np.ones((len(values), 1))], axis=1)
                yield from block_rows({(bi, n): whole[:, n * width : (n + 1) * width] for n in range(-(-whole.shape[1] // width))})

    inputs = groups.select("bi", "x").mapInArrow(split, block.SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)
    return TiledSamples(inputs, groups.select("bi", "labels", "shares"), facts[0], shape, [groups, inputs])


def _activated(grid: Grid):
    """Scores of a hidden layer to its outputs, with the constant behind the last unit."""
    units, width = grid.cols, grid.block_cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, nr, nc, data in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                with np.errstate(over="ignore"):
                    out = 1.0 / (1.0 + np.exp(-data.values.to_numpy().reshape(nr, nc, order="F")))
                made = {(bi, bj): out}
                if bj * width + nc == units:
                    ones = np.ones((nr, 1))
                    made = {(bi, bj): np.concatenate([out, ones], axis=1)} if nc < width else made | {(bi, bj + 1): ones}
                yield from block_rows(made)

    return run


TOP = block.SCHEMA + ", loss double, weight double"


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores, labels and shares of groups to deltas, loss and weight."""
    for batch in batches:
        numbers = zip(*(batch.column(c).to_pylist() for c in ("bi", "nr", "nc")), strict=True)
        for (bi, nr, nc), data, labels, shares in zip(numbers, *(batch.column(c) for c in ("data", "labels", "shares")), strict=True):
            raw, share = data.values.to_numpy().reshape(nr, nc, order="F"), shares.values.to_numpy()
            probability, logs = kernels.softmax(raw)
            hit = np.arange(nr), labels.values.to_numpy()
            loss = -float((share * logs[hit]).sum())
            delta = probability.copy()
            delta[hit] -= 1.0
            rows = list(block_rows({(bi, 0): delta * share[:, None]}))[0]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([loss]), pa.array([float(share.sum())])], [*rows.schema.names, "loss", "weight"]
            )


def _pulled(grid: Grid):
    """Deltas pulled through the weights, times the slope of the outputs; the constant's column is dropped."""
    units, width = grid.cols, grid.block_cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)
            for (bi, bj, nr, nc), data, out in zip(numbers, batch.column(4), batch.column(5), strict=True):
                z = out.values.to_numpy()
                delta = (data.values.to_numpy() * z * (1.0 - z)).reshape(nr, nc, order="F")[:, : units - bj * width]
                if delta.shape[1]:
                    yield from block_rows({(bi, bj): delta})

    return run


@dataclass
class TiledPass:
    """Gradient sums (``WEIGHTS``), loss sum and total weight of a pass, and what it keeps in memory."""

    gradient: DataFrame
    loss: float
    weight: float
    held: list[DataFrame]

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def layer_blocks(weights: DataFrame, shape: Shape, level: int) -> BlockMatrix:
    return BlockMatrix(weights.where(F.col("layer") == level).drop("layer"), shape.weights(level))


def forward(inputs: DataFrame, count: int, weights: DataFrame, shape: Shape, hold: Callable) -> list[BlockMatrix]:
    """Inputs of every layer, constant included, then the raw scores of the last one."""
    last = len(shape.layers) - 1
    chain = [BlockMatrix(inputs, shape.outputs(0, count, True))]
    for level in range(1, last + 1):
        scores = block.multiply(chain[-1], layer_blocks(weights, shape, level))
        if level < last:
            plain = shape.outputs(level, count, False)
            out = hold(scores.blocks.mapInArrow(_activated(plain), block.SCHEMA))
            chain.append(BlockMatrix(out, shape.outputs(level, count, True)))
        else:
            chain.append(scores)
    return chain


def sum_gradient(data: TiledSamples, weights: DataFrame, groups: Column | None = None) -> TiledPass:
    """One pass over all groups, or over those that the condition ``groups`` on ``bi`` picks."""
    shape, count, held = data.shape, data.count, []
    last = len(shape.layers) - 1

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    inputs, targets = data.inputs, data.targets
    if groups is not None:
        inputs, targets = inputs.where(groups), targets.where(groups)
    chain = forward(inputs, count, weights, shape, hold)
    top = hold(chain[-1].blocks.join(targets, "bi").mapInArrow(_top, TOP))
    sums = top.agg(F.sum("loss"), F.sum("weight")).first()
    delta = BlockMatrix(top.drop("loss", "weight"), shape.outputs(last, count, False))
    gradients = []
    for level in range(last, 0, -1):
        below = chain[level - 1]
        gradients.append(block.multiply(block.transpose(below), delta).blocks.select(F.lit(level).alias("layer"), "*"))
        if level > 1:
            pulled = block.multiply(delta, block.transpose(layer_blocks(weights, shape, level)))
            outs = below.blocks.select("bi", "bj", F.col("data").alias("z"))
            plain = shape.outputs(level - 1, count, False)
            met = pulled.blocks.join(outs, ["bi", "bj"]).select("bi", "bj", "nr", "nc", "data", "z")
            delta = BlockMatrix(hold(met.mapInArrow(_pulled(plain), block.SCHEMA)), plain)
    total = gradients[0]
    for other in gradients[1:]:
        total = total.unionAll(other)
    return TiledPass(total, sums[0] or 0.0, sums[1] or 0.0, held)


STEPPED = WEIGHTS + ", penalty double, moved double, size double"


def _stepped(updater, step: float, iteration: int, reg: float, scale: float):
    """The updater applied block by block; ``moved`` and ``size`` are squared norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, numbers = [], []
            for w, g in zip(batch.column("data"), batch.column("g"), strict=True):
                before = w.values.to_numpy()
                slope = g.values.to_numpy() * scale if g.is_valid else np.zeros_like(before)
                after, penalty = updater(before.copy(), slope, step, iteration, reg)
                made.append(np.asarray(after))
                numbers.append((float(penalty), float(((after - before) ** 2).sum()), float((after**2).sum())))
            keys = [batch.column(c) for c in ("layer", "bi", "bj", "nr", "nc")]
            sums = [pa.array([n[k] for n in numbers], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*keys, arrow.vector_rows(made), *sums], ["layer", "bi", "bj", "nr", "nc", "data", "penalty", "moved", "size"]
            )

    return run


def stepped(weights: DataFrame, gradient: DataFrame, scale: float, updater, step: float, iteration: int, reg: float) -> tuple:
    """(new weights, penalty, norm of the change, norm of the new weights); written. The updater must work value by value."""
    keys = ["layer", "bi", "bj"]
    met = weights.join(gradient.select(*keys, F.col("data").alias("g")), keys, "left").select(*keys, "nr", "nc", "data", "g")
    after = cut(met.mapInArrow(_stepped(updater, step, iteration, reg, scale), STEPPED))
    sums = after.agg(F.sum("penalty"), F.sqrt(F.sum("moved")), F.sqrt(F.sum("size"))).first()
    return after.drop("penalty", "moved", "size"), sums[0], sums[1], sums[2]


def to_blocks(table: DataFrame, shape: Shape) -> DataFrame:
    """A weights table ``(layer, out, in, w)`` as blocks; every place must be there."""
    made = None
    for level in range(1, len(shape.layers)):
        grid, n_in = shape.weights(level), shape.layers[level - 1]
        cells = network.layer_matrix(table, level).withColumn("i", F.when(F.col("i") == network.BIAS, n_in).otherwise(F.col("i")))
        blocks = block.to_blocks(cells, grid.block_rows, grid.block_cols, grid.rows, grid.cols, unique=True).blocks
        rows = blocks.select(F.lit(level).alias("layer"), "*")
        made = rows if made is None else made.unionAll(rows)
    return made


def to_table(weights: DataFrame, shape: Shape) -> DataFrame:
    """Weight blocks as the table ``(layer, out, in, w)``."""
    made = None
    for level in range(1, len(shape.layers)):
        cells = block.to_entries(layer_blocks(weights, shape, level))
        source = F.when(F.col("i") == shape.layers[level - 1], network.BIAS).otherwise(F.col("i")).cast("bigint")
        rows = cells.select(F.lit(level).alias("layer"), F.col("j").alias("out"), source.alias("in"), F.col("v").alias("w"))
        made = rows if made is None else made.unionAll(rows)
    return made


def start_blocks(spark: SparkSession, layers: list[int], shape: Shape, seed: int, initial: DataFrame | None) -> DataFrame:
    table = initial if initial is not None else network.initial_weights(spark, layers, seed)
    return cut(to_blocks(table.select("layer", "out", "in", "w"), shape))


def as_vector(weights: DataFrame) -> DataFrame:
    """Blocks of weights (or gradients) as a vector table ``(slot, v)``."""
    slot = F.shiftleft(F.col("layer").cast("bigint"), 48) + F.shiftleft(F.col("bi").cast("bigint"), 24) + F.col("bj")
    return weights.select(slot.alias("slot"), F.col("data").alias("v"))


def from_vector(vector: DataFrame, shape: Shape) -> DataFrame:
    """The way back: a block's size follows from its place in the layer's grid."""
    low = F.lit((1 << 24) - 1).cast("bigint")
    rows = vector.select(
        F.shiftright("slot", 48).cast("int").alias("layer"), F.shiftright("slot", 24).bitwiseAND(low).cast("int").alias("bi"),
        F.col("slot").bitwiseAND(low).cast("int").alias("bj"), "v",
    )
    nr = nc = F.lit(None).cast("int")
    for level in range(1, len(shape.layers)):
        grid, here = shape.weights(level), F.col("layer") == level
        nr, nc = F.when(here, grid.height(F.col("bi"))).otherwise(nr), F.when(here, grid.width(F.col("bj"))).otherwise(nc)
    return rows.select("layer", "bi", "bj", nr.alias("nr"), nc.alias("nc"), F.col("v").alias("data"))


def cost_of(data: TiledSamples) -> Callable[[DataFrame], tuple[float, DataFrame]]:
    """Mean loss and its gradient as functions of a vector table, for ``table_lbfgs.minimise``."""

    def cost(point: DataFrame) -> tuple[float, DataFrame]:
        result = sum_gradient(data, from_vector(point, data.shape))
        scale = 1.0 / result.weight
        slope = as_vector(result.gradient).select("slot", F.transform("v", lambda x: x * F.lit(scale)).alias("v"))
        slope = cut(slope)
        result.release()
        return result.loss * scale, slope

    return cost


def predict(samples: DataFrame, weights: DataFrame, layers: list[int], key: str, features: str = "features", group: int = 128) -> DataFrame:
    """``(key, prediction)`` of samples, whose ``key`` is a number of its own for each."""
    data = prepare(samples.withColumn("_none", F.lit(0)), layers, key=key, features=features, label="_none", group=group)
    try:
        scores = forward(data.inputs, data.count, weights, data.shape, lambda df: df)[-1]
        size = data.shape.group

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bi, nr, nc, values in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), batch.column(4), strict=True):
                    found = values.values.to_numpy().reshape(nr, nc, order="F").argmax(axis=1)
                    place = bi * size + np.arange(nr)
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(found.astype(np.float64))], ["place", "prediction"])

        places = numbered(samples.select(F.col(key).cast("bigint").alias("key")), "key", name="place")
        classes = scores.blocks.mapInArrow(best, "place bigint, prediction double")
        return cut(places.join(classes, "place").select(F.col("key").alias(key), "prediction"))
    finally:
        data.release()


@dataclass
class BlockedModel:
    """A fitted classifier whose weights are blocks: a table, not a vector on the driver."""

    layers: list[int]
    blocks: DataFrame
    shape: Shape
    history: list

    def weights_table(self, spark: SparkSession) -> DataFrame:
        return to_table(self.blocks, self.shape)

    def predict(self, samples: DataFrame, key: str, features: str = "features") -> DataFrame:
        return predict(samples, self.blocks, self.layers, key, features, self.shape.group)

    def loss_history(self, spark: SparkSession) -> DataFrame:
        rows = [(s.iteration, s.loss_sum, s.n, s.mean_loss) for s in self.history]
        return spark.createDataFrame(rows, "iteration int, loss_sum double, n double, mean_loss double")
