"""Iterative fits: gradient descent and L-BFGS over gradients that Spark sums up.

Each step is one job: a gradient kernel over Arrow batches of the persisted samples, one partial row
per partition, a tree sum. The driver only handles the model-sized result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from blockweave.functions import arrow, kernels
from blockweave.functions.columns import hash_uniform
from blockweave.operators.reduce import SCHEMA, partial_rows, tree_sum
from blockweave.operators.stack import assign_stacks, pack, unpack, with_share
from blockweave.plans import network, table_lbfgs, tiled_network
from blockweave.plans.search import wolfe_step
from blockweave.session import BROADCAST_BYTES, cut, scratch_path, shuffle_partitions

#: Most groups in which a fraction is drawn: the numbers drawn are listed in a condition.
MOST_GROUPS = 4096

#: ``gradient(batch, weights) -> (gradient sum, loss sum, weight of the batch)``. A batch has
#: ``features``, ``label`` or ``target``, and ``share``: the weight of each row.
Gradient = Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, float, float]]
#: ``updater(weights, gradient, step, iteration, reg) -> (new weights, penalty of the new weights)``.
Updater = Callable[[np.ndarray, np.ndarray, float, int, float], tuple[np.ndarray, float]]


def plain_step(
    weights: np.ndarray, gradient: np.ndarray, step: float, iteration: int, reg: float
) -> tuple[np.ndarray, float]:
    """A constant step against the gradient, without penalty; returns a new vector."""
    return weights - step * gradient, 0.0


def network_gradient(layers: list[int]) -> Gradient:
    """The classifier's gradient; labels outside the classes stop the job."""
    classes = layers[-1]

    def compute(batch: pa.RecordBatch, weights: np.ndarray):
        x = arrow.to_matrix(batch.column("features"))
        share = batch.column("share").to_numpy()
        if "target" in batch.schema.names:
            target = arrow.to_matrix(batch.column("target"))
        else:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            position = np.trunc(label)
            good = np.isfinite(position) & (position >= 0) & (position < classes)
            if not good.all():
                raise ValueError(f"label out of range: {label[~good][0]}")
            target = np.zeros((len(label), classes))
            target[np.arange(len(label)), position.astype(np.int64)] = 1.0
        flat, loss = kernels.gradient(weights, layers, x, target, share)
        return flat, loss, float(share.sum())

    return compute


@dataclass
class TrainingData:
    """Persisted samples and what is known of them.

    Packed samples are rows of whole batches as bytes, so an iteration hands them to the kernels
    without taking vectors apart. Samples that are drawn anew in each iteration stay one per row.
    """

    rows: DataFrame
    count: int
    parts: int
    packed: bool
    #: Width of the feature vectors, 0 without data.
    width: int = 0
    #: Number of groups that are drawn whole, 0 where stacks or rows are drawn.
    groups: int = 0

    @property
    def empty(self) -> bool:
        return self.count == 0

    def drawn(self, fraction: float, seed: int, draw: Callable[..., Column]) -> DataFrame:
        """The samples of an iteration; of groups only the files of those drawn are read."""
        if fraction == 1.0:
            return self.rows
        if self.groups:
            numbers = self.rows.sparkSession.range(self.groups).where(draw(F.col("id"), seed=seed) < fraction)
            # as many numbers as groups at most
            return self.rows.where(F.col("_group").isin([r["id"] for r in numbers.collect()]))
        if self.packed:
            raise ValueError("prepare the samples with the same fraction")
        return self.rows.where(draw(F.col("stack_id" if "stack_id" in self.rows.columns else "_draw"), seed=seed) < fraction)

    def release(self) -> None:
        self.rows.unpersist()


def _as_arrays(df: DataFrame) -> DataFrame:
    """Vector columns as arrays; sparse vectors stay sparse until this point."""
    for f in df.schema.fields:
        if isinstance(f.dataType, VectorUDT):
            df = df.withColumn(f.name, vector_to_array(f.name))
    return df


def prepare(
    samples: DataFrame,
    *,
    features: str = "features",
    label: str | None = "label",
    target: str | None = None,
    stack_size: int = 128,
    averaging: str = "stack",
    order_by: str | None = None,
    fraction: float = 1.0,
    groups: int = 0,
) -> TrainingData:
    """Choose columns, form stacks, persist, and count once.

    With a fraction and ``groups`` the samples are packed into that many groups (stacks by their number, rows by the hash
    of their key or content) and written to the checkpoint folder, a directory for each group, so that an
    iteration reads the groups that it draws and no others.
    """
    if not 0 <= groups <= MOST_GROUPS:
        raise ValueError(f"groups must be between 0 and {MOST_GROUPS}")
    if averaging not in ("stack", "row"):
        raise ValueError('averaging must be "stack" or "row"')
    if stack_size < 1:
        raise ValueError("stack size must be at least 1")
    result = F.col(target).alias("target") if target else F.col(label).cast("double").alias("label")
    picked = [F.col(features).alias("features"), result]
    name = "target" if target else "label"
    stacked = averaging == "stack" and stack_size > 1
    stream_size = None
    if stacked and (order_by is not None or fraction < 1.0):
        if order_by is not None:
            picked.append(F.col(order_by).alias("_order"))
        rows = assign_stacks(samples.select(*picked), stack_size, order_by and "_order")
        rows = rows.select("features", name, "stack_id", (1.0 / F.col("stack_n")).alias("share"))
    else:
        rows = samples.select(*picked)
        stream_size = stack_size if stacked else None
        if fraction < 1.0:  # rows are drawn anew in each iteration, by their key or else their content
            if order_by is not None:
                picked.append(F.col(order_by).alias("_order"))
            rows = _as_arrays(samples.select(*picked))
            drawn = ["_order"] if order_by is not None else ["features", name]
            rows = rows.withColumn("_draw", F.xxhash64(*drawn)).drop("_order")
    if fraction < 1.0 and groups:
        return _in_groups(rows, groups)
    packed = fraction == 1.0
    if packed:
        rows = pack(_as_arrays(rows.drop("stack_id")), stream_size)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    sized = rows if packed else _as_arrays(rows).select(
        F.lit(1).alias("n"), F.size("features").alias("width")
    )
    per_part = sized.groupBy(F.spark_partition_id().alias("p")).agg(
        F.sum("n").alias("n"), F.min("width").alias("lo"), F.max("width").alias("hi")
    )
    facts = per_part.agg(F.sum("n"), F.count("*"), F.min("lo"), F.max("hi")).first()
    if facts[2] != facts[3]:
        rows.unpersist()
        raise ValueError(f"feature vectors have between {facts[2]} and {facts[3]} values")
    return TrainingData(rows, facts[0] or 0, facts[1], packed, facts[3] or 0)


def _in_groups(rows: DataFrame, groups: int) -> TrainingData:
    """Samples packed by group. A group may take many tasks, as rows are dealt by ranges of group and place."""
    place = "stack_id" if "stack_id" in rows.columns else "_draw"
    rows = _as_arrays(rows).withColumn("_group", F.pmod(place, F.lit(groups)).cast("bigint"))
    dealt = rows.repartitionByRange("_group", place, F.spark_partition_id()).sortWithinPartitions("_group", place)
    packed = pack(dealt.drop("stack_id", "_draw"), None, "_group")
    path, schema = scratch_path(rows.sparkSession, "samples"), packed.schema
    packed.write.partitionBy("_group").parquet(path)
    packed = rows.sparkSession.read.schema(schema).parquet(path)
    facts = packed.agg(F.sum("n"), F.count("*"), F.min("width"), F.max("width")).first()
    if facts[2] != facts[3]:
        raise ValueError(f"feature vectors have between {facts[2]} and {facts[3]} values")
    parts = min(facts[1], shuffle_partitions(rows.sparkSession) + groups)  # files, about
    return TrainingData(packed, facts[0] or 0, parts, True, facts[3] or 0, groups)


def sum_gradient(
    data: TrainingData,
    gradient: Gradient,
    weights: np.ndarray,
    fraction: float = 1.0,
    seed: int = 0,
    draw: Callable[..., Column] = hash_uniform,
) -> tuple[np.ndarray, float, float]:
    """Gradient sum, loss sum and total weight over all samples, or over a sample of the stacks.

    ``draw`` is a number in [0, 1) from the stack (or row, or group) and the seed, by default a hash.
    """
    spark = data.rows.sparkSession
    if weights.nbytes > BROADCAST_BYTES:
        raise ValueError("the weights exceed the broadcast limit; keep them in blocks")
    packed = data.packed
    rows = data.drawn(fraction, seed, draw).drop("_group")
    if not packed:
        rows = _as_arrays(rows.drop("stack_id", "_draw"))
    size = weights.size
    shared = spark.sparkContext.broadcast(weights)

    def run(batches):
        current = shared.value
        # Behind the gradient: the loss and the weight of the samples seen.
        sums = np.zeros(size + 2)
        for batch in unpack(batches) if packed else map(with_share, batches):
            if not batch.num_rows:
                continue
            g, loss, weight = gradient(batch, current)
            sums[:size] += g
            sums[size:] += loss, weight
        if sums[-1]:
            yield partial_rows(sums)

    try:
        total = tree_sum(rows.mapInArrow(run, SCHEMA), data.parts, size + 2)
    finally:
        shared.destroy()
    if total is None:
        return np.zeros(size), 0.0, 0.0
    return total[:size], float(total[size]), float(total[size + 1])


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class SgdSettings:
    step: float = 1.0
    iterations: int = 100
    reg: float = 0.0
    fraction: float = 1.0
    #: 0 runs all iterations; above 0 the fit stops when the weights settle.
    tol: float = 0.0
    #: Groups in which a fraction is drawn, so that an iteration reads only these; 0 draws stack by stack from all.
    #: Weights in blocks always draw groups of the stack size.
    groups: int = 0

    def __post_init__(self):
        _check(self.step > 0, "step must be positive")
        _check(self.iterations >= 0, "iterations must not be negative")
        _check(self.reg >= 0, "reg must not be negative")
        _check(0 < self.fraction <= 1, "fraction must be above 0 and at most 1")
        _check(0 <= self.tol <= 1, "tol must be between 0 and 1")
        _check(0 <= self.groups <= MOST_GROUPS, f"groups must be between 0 and {MOST_GROUPS}")


@dataclass(frozen=True)
class LbfgsSettings:
    corrections: int = 10
    tol: float = 1e-6
    iterations: int = 200
    reg: float = 0.0

    def __post_init__(self):
        _check(self.corrections > 0, "corrections must be positive")
        _check(self.tol >= 0, "tol must not be negative")
        _check(self.iterations >= 0, "iterations must not be negative")
        _check(self.reg >= 0, "reg must not be negative")


@dataclass(frozen=True)
class Step:
    """One line of a fit's history."""

    iteration: int
    loss_sum: float
    n: float
    mean_loss: float


HISTORY = "iteration int, loss_sum double, n double, mean_loss double"


def settled(before: np.ndarray, after: np.ndarray, tol: float) -> bool:
    return bool(np.linalg.norm(before - after) < tol * max(np.linalg.norm(after), 1.0))


def run_sgd(
    data: TrainingData,
    weights: np.ndarray,
    gradient: Gradient,
    updater: Updater = plain_step,
    settings: SgdSettings | None = None,
    draw: Callable[..., Column] = hash_uniform,
) -> tuple[np.ndarray, list[Step]]:
    """Gradient descent with a fixed number of steps; the caller's weights are not changed."""
    settings = settings or SgdSettings()
    if settings.reg and updater is plain_step:
        raise ValueError("the plain updater has no penalty; give an updater that uses reg")
    weights = np.array(weights, dtype=np.float64)
    history: list[Step] = []
    if data.empty:
        return weights, history
    penalty = updater(weights.copy(), np.zeros_like(weights), 0.0, 1, settings.reg)[1]
    for iteration in range(1, settings.iterations + 1):
        total, loss, n = sum_gradient(data, gradient, weights, settings.fraction, 42 + iteration, draw)
        if not n:
            continue
        history.append(Step(iteration, loss, n, loss / n + penalty))
        before = weights
        weights, penalty = updater(before.copy(), total / n, settings.step, iteration, settings.reg)
        if settings.tol and settled(before, weights, settings.tol):
            break
    return weights, history


def run_lbfgs(
    data: TrainingData,
    weights: np.ndarray,
    gradient: Gradient,
    updater: Updater = plain_step,
    settings: LbfgsSettings | None = None,
) -> tuple[np.ndarray, list[Step]]:
    """Limited-memory BFGS; every trial point is one Spark job over the persisted samples."""
    settings = settings or LbfgsSettings()
    if settings.reg and updater is plain_step:
        raise ValueError("the plain updater has no penalty; give an updater that uses reg")
    weights = np.array(weights, dtype=np.float64)
    if data.empty:
        return weights, []

    def cost(w: np.ndarray):
        total, loss, n = sum_gradient(data, gradient, w)
        zero = np.zeros_like(w)
        penalty = updater(w.copy(), zero, 0.0, 1, settings.reg)[1]
        pull = w - updater(w.copy(), zero, 1.0, 1, settings.reg)[0]
        return loss / n + penalty, total / n + pull, loss, n

    value, slope, loss, n = cost(weights)
    history = [Step(0, loss, n, value)]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for iteration in range(1, settings.iterations + 1):
        if np.linalg.norm(slope) <= max(settings.tol * abs(value), 1e-12):
            break
        direction = -_inverse_product(pairs, slope)
        if slope @ direction >= 0:
            pairs.clear()
            direction = -slope
        start = 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(slope))

        def at(step: float, point=weights, direction=direction):
            moved = point + step * direction
            result = cost(moved)
            return result[0], float(result[1] @ direction), moved, result

        found = wolfe_step(at, value, float(slope @ direction), start)
        if found is None:
            break
        new_weights, (new_value, new_slope, loss, n) = found[2:]
        moved, bent = new_weights - weights, new_slope - slope
        if moved @ bent > 1e-12 * (bent @ bent):
            pairs = [*pairs, (moved, bent)][-settings.corrections :]
        change = abs(value - new_value)
        weights, slope = new_weights, new_slope
        history.append(Step(iteration, loss, n, new_value))
        scale = max(abs(value), abs(new_value), 1e-6 * abs(history[0].mean_loss))
        value = new_value
        if change <= settings.tol * scale:
            break
    return weights, history


def _inverse_product(pairs, slope: np.ndarray) -> np.ndarray:
    """Approximate inverse curvature times the slope, from the kept pairs."""
    result = slope.copy()
    scales = []
    for moved, bent in reversed(pairs):
        scale = (moved @ result) / (moved @ bent)
        result -= scale * bent
        scales.append(scale)
    if pairs:
        moved, bent = pairs[-1]
        result *= (moved @ bent) / (bent @ bent)
    for (moved, bent), scale in zip(pairs, reversed(scales), strict=True):
        result += moved * (scale - (bent @ result) / (moved @ bent))
    return result


@dataclass
class MlpModel:
    """A fitted classifier: the layer sizes, the flat weight vector and the losses on the way."""

    layers: list[int]
    weights: np.ndarray
    history: list[Step] = field(default_factory=list)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        from blockweave.plans.scoring import add_prediction

        return add_prediction(df, self.weights, self.layers, features)

    def weights_table(self, spark: SparkSession) -> DataFrame:
        return network.weights_table(spark, self.weights, self.layers)

    def loss_history(self, spark: SparkSession) -> DataFrame:
        rows = [(s.iteration, s.loss_sum, s.n, s.mean_loss) for s in self.history]
        return spark.createDataFrame(rows, HISTORY)


def check_weights(weights: np.ndarray, layers: list[int]) -> np.ndarray:
    weights = np.asarray(weights, dtype=np.float64)
    expected = kernels.weight_count(layers)
    if weights.shape != (expected,):
        raise ValueError(f"expected a weight vector of size {expected} but got {weights.size}")
    return weights


def fit_mlp(
    samples: DataFrame,
    layers: list[int],
    *,
    solver: str = "sgd",
    settings: SgdSettings | LbfgsSettings | None = None,
    stack_size: int = 128,
    averaging: str = "stack",
    order_by: str | None = None,
    features: str = "features",
    label: str | None = "label",
    target: str | None = None,
    seed: int = 11,
    initial_weights: np.ndarray | None = None,
    gradient: Gradient | None = None,
    updater: Updater = plain_step,
    layout: str = "auto",
) -> MlpModel | tiled_network.BlockedModel:
    """Train a classifier. Give ``initial_weights`` (a vector, or a weights table) to start from an earlier model.

    ``layout`` is where the weights live: ``"vector"`` on the driver and in every task, ``"blocks"`` in a table, and
    ``"auto"`` takes blocks for models above the broadcast limit. Settings are the same for both. Blocks need
    labels, not targets, and an ``order_by`` that is a number of its own for each sample (one is made if not given).
    """
    spark = samples.sparkSession
    network.check_layers(layers)
    if layout not in ("auto", "vector", "blocks"):
        raise ValueError('layout must be "auto", "vector" or "blocks"')
    if solver not in ("sgd", "l-bfgs"):
        raise ValueError('solver must be "sgd" or "l-bfgs"')
    settings = settings or (SgdSettings() if solver == "sgd" else LbfgsSettings())
    wanted = SgdSettings if solver == "sgd" else LbfgsSettings
    if not isinstance(settings, wanted):
        raise ValueError(f"solver {solver} needs {wanted.__name__}")
    large = kernels.weight_count(layers) * 8 > BROADCAST_BYTES
    if layout == "blocks" or (layout == "auto" and (large or isinstance(initial_weights, DataFrame))):
        if target is not None or gradient is not None:
            raise ValueError("weights in blocks need labels and the network's own gradient")
        if initial_weights is not None and not isinstance(initial_weights, DataFrame):
            initial_weights = network.weights_table(spark, check_weights(initial_weights, layers), layers)
        if order_by is None:  # written, so that a sample keeps its number
            samples, order_by = cut(samples.withColumn("_sample_no", F.monotonically_increasing_id())), "_sample_no"
        return fit_blocked(
            _as_arrays(samples), layers, settings, key=order_by, features=features, label=label, stack_size=stack_size,
            averaging=averaging, seed=seed, initial=initial_weights, updater=updater,
        )
    if isinstance(initial_weights, DataFrame):
        initial_weights = network.weights_vector(initial_weights, layers)
    if initial_weights is not None:
        initial_weights = check_weights(initial_weights, layers)
    elif kernels.weight_count(layers) * 8 > BROADCAST_BYTES:
        raise ValueError("the model exceeds the broadcast limit; keep its weights in blocks")
    else:
        initial_weights = network.weights_vector(
            network.initial_weights(spark, layers, seed), layers
        )
    data = prepare(
        samples, features=features, label=label, target=target, stack_size=stack_size,
        averaging=averaging, order_by=order_by, fraction=getattr(settings, "fraction", 1.0),
        groups=getattr(settings, "groups", 0),
    )
    try:
        if gradient is None and not data.empty and data.width != layers[0]:
            raise ValueError(f"expected {layers[0]} features but got {data.width}")
        run = run_sgd if solver == "sgd" else run_lbfgs
        fitted, history = run(
            data, initial_weights, gradient or network_gradient(layers), updater, settings
        )
        return MlpModel(list(layers), fitted, history)
    finally:
        data.release()


def fit_mlp_relational(
    samples: DataFrame,
    layers: list[int],
    *,
    key: str,
    iterations: int | None = None,
    step: float = 1.0,
    settings: SgdSettings | None = None,
    features: str = "features",
    label: str = "label",
    share: str | None = None,
    stack_size: int = 128,
    averaging: str = "row",
    seed: int = 11,
    initial: DataFrame | None = None,
    updater: Updater = plain_step,
    draw: Callable[..., Column] = hash_uniform,
    unit_block: int = tiled_network.UNIT_BLOCK,
) -> tuple[DataFrame, list[Step]]:
    """Gradient descent for a model too large to broadcast: weights are blocks throughout.

    ``key`` is a number that identifies a sample; samples lie in groups of ``stack_size`` in its order. The settings
    are those of ``fit_mlp``; ``fraction`` draws whole groups, and an iteration reads only these. An ``updater`` is applied block by
    block, so it must work value by value. ``share`` is a sample's weight, on top of ``averaging``.
    """
    settings = settings or SgdSettings(step=step, iterations=100 if iterations is None else iterations)
    model = fit_blocked(
        samples, layers, settings, key=key, features=features, label=label, share=share, stack_size=stack_size,
        averaging=averaging, seed=seed, initial=initial, updater=updater, draw=draw, unit_block=unit_block,
    )
    return model.weights_table(samples.sparkSession), model.history


def fit_blocked(
    samples: DataFrame, layers: list[int], settings: SgdSettings | LbfgsSettings, *, key: str, features: str = "features",
    label: str = "label", share: str | None = None, stack_size: int = 128, averaging: str = "row", seed: int = 11,
    initial: DataFrame | None = None, updater: Updater = plain_step, draw: Callable[..., Column] = hash_uniform,
    unit_block: int = tiled_network.UNIT_BLOCK,
) -> tiled_network.BlockedModel:
    """A fit whose weights stay blocks, by gradient descent or L-BFGS, as the settings say."""
    if settings.reg and updater is plain_step:
        raise ValueError("the plain updater has no penalty; give an updater that uses reg")
    if isinstance(settings, LbfgsSettings) and settings.reg:
        raise ValueError("L-BFGS on blocks has no penalty")
    data = tiled_network.prepare(
        samples, layers, key=key, features=features, label=label, share=share, group=stack_size,
        averaging=averaging, unit_block=unit_block,
    )
    try:
        weights = tiled_network.start_blocks(samples.sparkSession, layers, data.shape, seed, initial)
        history: list[Step] = []
        if data.count and isinstance(settings, LbfgsSettings):
            n = data.targets.agg(F.sum(F.aggregate("shares", F.lit(0.0), lambda s, x: s + x))).first()[0]
            found, values = table_lbfgs.minimise(
                tiled_network.as_vector(weights), tiled_network.cost_of(data),
                corrections=settings.corrections, tol=settings.tol, iterations=settings.iterations,
            )
            weights = cut(tiled_network.from_vector(found, data.shape))
            history = [Step(k, value * n, n, value) for k, value in values]
        elif data.count and settings.iterations:
            weights, history = _blocked_sgd(data, weights, updater, settings, draw)
        return tiled_network.BlockedModel(list(layers), weights, data.shape, history)
    finally:
        data.release()


def _blocked_sgd(
    data: tiled_network.TiledSamples, weights: DataFrame, updater: Updater, settings: SgdSettings, draw: Callable[..., Column]
) -> tuple[DataFrame, list[Step]]:
    history: list[Step] = []
    nothing = weights.limit(0)
    penalty = tiled_network.stepped(weights, nothing, 0.0, updater, 0.0, 1, settings.reg)[1] if settings.reg else 0.0
    for iteration in range(1, settings.iterations + 1):
        chosen = draw(F.col("bi"), seed=42 + iteration) < settings.fraction if settings.fraction < 1.0 else None
        result = tiled_network.sum_gradient(data, weights, chosen)
        try:
            if not result.weight:
                continue
            history.append(Step(iteration, result.loss, result.weight, result.loss / result.weight + penalty))
            weights, penalty, moved, size = tiled_network.stepped(
                weights, result.gradient, 1.0 / result.weight, updater, settings.step, iteration, settings.reg
            )
        finally:
            result.release()
        if settings.tol and moved < settings.tol * max(size, 1.0):
            break
    return weights, history


def key_sample(
    df: DataFrame, key: str, fraction: float, seed: int, rule: Column | None = None
) -> DataFrame:
    """A sample without replacement that depends only on the key and the seed, so it can be repeated.

    ``rule`` is a number in [0, 1) for each row; by default a hash of key and seed.
    """
    _check(0 < fraction <= 1, "fraction must be above 0 and at most 1")
    place = rule if rule is not None else hash_uniform(F.col(key), seed=seed)
    return df.where(place < F.lit(fraction))
