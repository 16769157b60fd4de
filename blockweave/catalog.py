"""The registered queries: every operator over whole tables of a data folder.

Each takes ``(spark, folder)`` and returns a DataFrame. The ratings matrix is quantity by customer and
part; the small dense matrix is supplier by line number; the samples are the labelled embeddings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.functions import arrow
from blockweave.functions.columns import argmax, one_hot
from blockweave.operators import block, entry, factor, gram_tiles, sparse_block, stack
from blockweave.plans import network, nmf, report, scoring, table_lbfgs, training
from blockweave.session import cut, scratch_path
from blockweave.sources import libsvm, ratings as rating_files

RANK = 8
LAYERS = [64, 16, 10]
STACK = 48
#: Groups of stacks from which a fit draws.
GROUPS = 8
STEP = 0.5
TALL = (128, 32)
SMALL = (48, 3)
#: Blocks of the ratings matrix.
RATINGS = (512, 1024)

QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# --- inputs -------------------------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def rating_rows(spark: SparkSession, folder: str, value: Column | str = "l_quantity") -> DataFrame:
    """Raw ratings with repeated cells."""
    return entry.to_entries(order_lines(spark, folder), "o_custkey", "l_partkey", value)


def flagged(spark: SparkSession, folder: str, flag: str, having: bool = True) -> DataFrame:
    """Summed quantities of the lines that have a return flag, or of all others."""
    lines = order_lines(spark, folder).where((F.col("l_returnflag") == flag) == F.lit(having))
    return entry.sum_duplicates(entry.to_entries(lines, "o_custkey", "l_partkey", "l_quantity"))


def supply_rows(spark: SparkSession, folder: str, value: str = "l_quantity") -> DataFrame:
    return entry.to_entries(table(spark, folder, "lineitem"), "l_suppkey", "l_linenumber", value)


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").alias("features"), "label"
    )


def formula_factor(ids: DataFrame, rank: int, a: int, b: int, modulus: int) -> DataFrame:
    """Repeatable factor rows ``((id*a + k*b) % modulus + 1) / modulus``."""

    def value(k: Column) -> Column:
        return ((F.col("id") * a + k * b) % modulus + 1) / F.lit(float(modulus))

    ranks = F.sequence(F.lit(0).cast("bigint"), F.lit(rank - 1).cast("bigint"))
    return ids.select("id", F.transform(ranks, value).alias("f"))


def formula_uniform(*places: Column, seed: int) -> Column:
    """Values in [0, 1) of one or two places and a seed, in plain arithmetic."""
    total = F.lit(seed * 104_729).cast("bigint")
    for place, by in zip(places, (386_117, 50_021), strict=False):
        total = total + place.cast("bigint") * F.lit(by)
    return F.pmod(total, F.lit(1_000_003)) / F.lit(1_000_003.0)


def start_w(ids: DataFrame, rank: int) -> DataFrame:
    return formula_factor(ids, rank, 31, 17, 97)


def start_h(ids: DataFrame, rank: int) -> DataFrame:
    return formula_factor(ids, rank, 29, 13, 89)


def positions(entries: DataFrame, index: str) -> DataFrame:
    """The indices that occur on one side of a matrix."""
    return entries.select(F.col(index).alias("id")).distinct()


def start_weights() -> np.ndarray:
    """Repeatable network weights for ``LAYERS``."""
    parts = []
    for (a, b, m), n_in, n_out in zip(
        ((31, 17, 97), (29, 13, 89)), LAYERS[:-1], LAYERS[1:], strict=True
    ):
        source = np.append(np.arange(n_in), network.BIAS)[:, None]
        unit = np.arange(n_out)[None, :]
        turned = np.fmod(unit * a + source * b, m) / float(m)
        parts.append(((turned * 4.8 - 2.4) / np.sqrt(n_in)).reshape(-1))
    return np.concatenate(parts)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Round float results; adding 0.0 turns a negative zero into zero."""
    return df.withColumns({n: F.round(n, places) + F.lit(0.0) for n in names})


# --- matrix construction and inspection ---------------------------------------------------------


@query
def ratings_entries(spark, folder):
    return rounded(entry.sum_duplicates(rating_rows(spark, folder)), "v")


@query
def matrix_shape(spark, folder):
    return entry.matrix_shape(rating_rows(spark, folder))


@query
def matrix_profile(spark, folder):
    return entry.matrix_profile(entry.sum_duplicates(rating_rows(spark, folder)), 128, 256)


@query
def matrix_transpose(spark, folder):
    return rounded(entry.transpose(entry.sum_duplicates(rating_rows(spark, folder))), "v")


@query
def dense_to_sparse(spark, folder):
    rows = supply_rows(spark, folder)
    size = entry.matrix_shape(rows).first()
    dense = entry.to_dense(entry.sum_duplicates(rows), size["rows"], size["cols"])
    return rounded(entry.to_sparse(dense), "v")


@query
def sparse_to_dense(spark, folder):
    rows = supply_rows(spark, folder)
    size = entry.matrix_shape(rows).first()
    return rounded(entry.to_dense(entry.sum_duplicates(rows), size["rows"], size["cols"]), "v")


# --- joins and matrix operators -----------------------------------------------------------------


@query
def matrix_multiply(spark, folder):
    """A·Hᵀ in entry form."""
    a = entry.sum_duplicates(rating_rows(spark, folder))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("id"))
    h = factor.to_entries(start_h(parts, RANK))
    return rounded(entry.multiply(a, h, b_cells=parts.count() * RANK), "v")


@query
def gram_matrix(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    return rounded(factor.gram_entries(start_w(customers, RANK), RANK), "v")


@query
def gram_entry_form(spark, folder):
    """MᵀM of the dense supplier matrix, from entries; its columns are counted first."""
    cells = entry.sum_duplicates(supply_rows(spark, folder, "l_discount"))
    return rounded(entry.gram(cells, entry.matrix_shape(cells).first()["cols"]), "v")


@query
def elementwise_product(spark, folder):
    a = entry.sum_duplicates(rating_rows(spark, folder))
    return rounded(entry.elementwise_product(a, flagged(spark, folder, "R")), "v")


@query
def elementwise_division(spark, folder):
    """Total over returned quantity; infinite where nothing was returned."""
    a = entry.sum_duplicates(rating_rows(spark, folder))
    return rounded(entry.elementwise_division(a, flagged(spark, folder, "R")), "v")


@query
def multiply_divide(spark, folder):
    a = entry.sum_duplicates(rating_rows(spark, folder))
    price = entry.sum_duplicates(rating_rows(spark, folder, F.col("l_extendedprice") / 1000.0))
    return rounded(entry.multiply_divide(a, flagged(spark, folder, "R"), price), "v")


@query
def matrix_cogroup(spark, folder):
    """Returned quantity against all other quantity of each cell."""
    both = entry.cogroup(flagged(spark, folder, "R"), flagged(spark, folder, "R", False))
    return rounded(both, "a", "b")


@query
def matrix_cogroup3(spark, folder):
    three = entry.cogroup3(*(flagged(spark, folder, flag) for flag in "RAN"))
    return rounded(three, "a", "b", "c")


# --- block form ---------------------------------------------------------------------------------


def sample_entries(spark, folder) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return rows.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select(
        "i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v")
    )


def sample_blocks(spark, folder) -> block.BlockMatrix:
    return block.to_blocks(sample_entries(spark, folder), *TALL, unique=True)


def supply_blocks(spark, folder, value: str) -> block.BlockMatrix:
    return block.to_blocks(supply_rows(spark, folder, value), *SMALL)


@query
def to_blocks(spark, folder):
    blocks = sample_blocks(spark, folder).blocks
    cells = blocks.select("bi", "bj", "nr", "nc", F.posexplode("data").alias("pos", "v"))
    return rounded(cells, "v")


@query
def from_blocks(spark, folder):
    return rounded(block.to_entries(sample_blocks(spark, folder)), "v")


@query
def keyed_blocks(spark, folder):
    """The cells of a matrix rebuilt from its blocks alone."""
    blocks = sample_blocks(spark, folder).blocks
    return rounded(block.to_entries(block.from_keyed_blocks(blocks, *TALL)), "v")


@query
def block_transpose(spark, folder):
    return rounded(block.to_entries(block.transpose(sample_blocks(spark, folder))), "v")


@query
def block_multiply(spark, folder):
    """Samples times the first weight matrix."""
    weights = network.layer_matrix(network.weights_table(spark, start_weights(), LAYERS), 1)
    matrix = block.to_blocks(weights.where(F.col("i") >= 0), TALL[1], 8, LAYERS[0], LAYERS[1])
    return rounded(block.to_entries(block.multiply(sample_blocks(spark, folder), matrix)), "v")


@query
def block_gram(spark, folder):
    tall = sample_blocks(spark, folder)
    return rounded(block.to_entries(block.multiply(block.transpose(tall), tall)), "v")


def rating_blocks(spark, folder) -> block.BlockMatrix:
    """The ratings in sparse blocks."""
    return sparse_block.to_sparse_blocks(rating_rows(spark, folder), *RATINGS)


def factor_blocks(ids: DataFrame, start, height: int, rows: int) -> block.BlockMatrix:
    return block.to_blocks(factor.to_entries(start(ids, RANK)), height, RANK, rows, RANK, unique=True)


@query
def sparse_blocks(spark, folder):
    """Every stored cell of the ratings' sparse blocks by its column in the block."""
    blocks = rating_blocks(spark, folder).blocks
    columns = F.posexplode(F.slice("starts", 1, F.size("starts") - 1)).alias("col", "first")
    opened = blocks.select("bi", "bj", "nr", "nc", "starts", "places", "data", columns)
    n = F.get("starts", F.col("col") + 1) - F.col("first")
    held = F.arrays_zip(F.slice("places", F.col("first") + 1, n).alias("row"), F.slice("data", F.col("first") + 1, n).alias("v"))
    return opened.select("bi", "bj", "nr", "nc", "col", F.inline(held)).withColumnRenamed("0", "row").withColumnRenamed("1", "v")


@query
def block_sparse_multiply(spark, folder):
    """Ratings in sparse blocks times the items' factor in dense ones."""
    ratings = rating_blocks(spark, folder)
    items = factor_blocks(positions(rating_rows(spark, folder), "j"), start_h, RATINGS[1], ratings.grid.cols)
    cells = entry.to_sparse(block.to_entries(block.multiply(ratings, items)))
    return rounded(cells.select("i", F.col("j").alias("k"), "v"), "v")


@query
def block_sparse_project(spark, folder):
    """The same ratings, turned without being made dense, times the users' factor."""
    ratings = sparse_block.transpose(rating_blocks(spark, folder))
    users = factor_blocks(positions(rating_rows(spark, folder), "i"), start_w, RATINGS[0], ratings.grid.cols)
    cells = entry.to_sparse(block.to_entries(block.multiply(ratings, users)))
    return rounded(cells.select(F.col("i").alias("j"), F.col("j").alias("k"), "v"), "v")


def sample_factor(spark, folder) -> DataFrame:
    return samples(spark, folder).select(F.col("vec_id").alias("id"), F.col("features").cast("array<double>").alias("f"))


@query
def gram_large_rank(spark, folder):
    """The embeddings' Gram matrix from symmetric tiles."""
    return rounded(block.to_entries(gram_tiles.gram_blocks(sample_factor(spark, folder), LAYERS[0], 24)), "v")


@query
def gram_apply(spark, folder):
    """The embeddings times their Gram matrix, tile by tile."""
    rows = sample_factor(spark, folder)
    return rounded(factor.to_entries(gram_tiles.apply_gram(rows, gram_tiles.gram_blocks(rows, LAYERS[0], 24))), "v", places=4)


@query
def block_product(spark, folder):
    a, b = (supply_blocks(spark, folder, c) for c in ("l_quantity", "l_discount"))
    return rounded(block.to_entries(block.elementwise_product(a, b)), "v")


@query
def block_division(spark, folder):
    a, b = (supply_blocks(spark, folder, c) for c in ("l_extendedprice", "l_quantity"))
    cells = block.to_entries(block.elementwise_division(a, b))
    return rounded(cells.select("i", "j", F.nanvl("v", F.lit(-1.0)).alias("v")), "v")


@query
def block_multiply_divide(spark, folder):
    names = ("l_quantity", "l_discount", "l_tax")
    return rounded(
        block.to_entries(block.multiply_divide(*(supply_blocks(spark, folder, c) for c in names))), "v"
    )


@query
def block_profile(spark, folder):
    return block.profile(supply_blocks(spark, folder, "l_quantity"))


@query
def block_validate(spark, folder):
    """Faults planted in the sample matrix: repeated, cut and misplaced blocks."""
    whole = sample_blocks(spark, folder)
    b = whole.blocks
    cut_data = F.when(F.col("bi") % 3 == 1, F.slice("data", 1, F.size("data") - 1)).otherwise(F.col("data"))
    last = F.col("bi") == whole.grid.row_blocks - 1
    moved = F.when(last, F.col("bi") + 7).otherwise(F.col("bi")).cast("int")
    broken = b.withColumn("data", cut_data).withColumn("bi", moved)
    broken = broken.unionAll(broken.where((F.col("bi") % 2 == 0) & (F.col("bj") == 0)))
    return block.validate(block.BlockMatrix(broken, whole.grid))


@query
def block_grid(spark, folder):
    """All block coordinates of the ratings matrix in 128 x 256 blocks."""
    size = entry.matrix_shape(rating_rows(spark, folder)).first()
    grid = block.Grid(size["rows"], size["cols"], 128, 256)
    return block.block_grid(spark, grid.row_blocks, grid.col_blocks)


@query
def grid_placement(spark, folder):
    """Tile of each block when the grid is cut into about four tiles."""
    matrix = sample_blocks(spark, folder)
    sides = block.tile_sides(matrix.grid, 4)
    return matrix.blocks.select("bi", "bj", block.tile_number(matrix.grid, sides).alias("part"))


# --- factorisation ------------------------------------------------------------------------------


@query
def factor_init(spark, folder):
    ids = positions(rating_rows(spark, folder), "i")
    return rounded(factor.to_entries(start_w(ids, RANK)), "v")


@query
def random_factor(spark, folder):
    """Seeded rows by a rule that SQL can repeat."""
    ids = positions(rating_rows(spark, folder), "i")
    return rounded(factor.to_entries(factor.random_factor(ids, RANK, 7, formula_uniform)), "v")


@query
def random_blocks(spark, folder):
    """A seeded matrix of the supplier matrix's size, by a rule that SQL can repeat."""
    size = entry.matrix_shape(supply_rows(spark, folder)).first()
    grid = block.Grid(size["rows"], size["cols"], *SMALL)
    return rounded(block.to_entries(block.random_blocks(spark, grid, 7, formula_uniform)), "v")


def one_update(spark, folder, rank: int, side: str) -> DataFrame:
    layout = nmf.Ratings(rating_rows(spark, folder), reuse=False)
    try:
        w = start_w(positions(layout.cells, "i"), rank)
        h = start_h(positions(layout.cells, "j"), rank)
        step = nmf.update_h if side == "h" else nmf.update_w
        return cut(step(layout, w, h, rank))
    finally:
        layout.release()


@query
def nmf_update_h(spark, folder):
    cells = factor.to_entries(one_update(spark, folder, RANK, "h"))
    return rounded(cells.select(F.col("j").alias("k"), F.col("i").alias("j"), "v"), "v")


@query
def nmf_update_w(spark, folder):
    cells = factor.to_entries(one_update(spark, folder, RANK, "w"))
    return rounded(cells.select("i", F.col("j").alias("k"), "v"), "v")


def start_factors(spark, folder, rank: int) -> dict[str, DataFrame]:
    """Repeatable factors for all ids up to the largest one that is rated."""
    size = entry.matrix_shape(rating_rows(spark, folder)).first()
    return {"w": start_w(spark.range(size["rows"]), rank), "h": start_h(spark.range(size["cols"]), rank)}


def ratings_fit(entries: DataFrame, iterations: int, rank: int = RANK, **options) -> nmf.Factors:
    """A fit from repeatable factors for all ids up to the largest one that is rated."""
    return nmf.fit(entries, rank, iterations, w=lambda ids: start_w(ids, rank), h=lambda ids: start_h(ids, rank), **options)


def both_factors(fitted: nmf.Factors) -> DataFrame:
    tables = [
        factor.to_entries(rows).select(F.lit(name).alias("factor"), F.col("i").alias("id"), F.col("j").alias("k"), "v")
        for name, rows in (("W", fitted.w), ("H", fitted.h))
    ]
    return rounded(tables[0].unionAll(tables[1]), "v")


@query
def nmf_fit_2iter(spark, folder):
    """Both factors of the ratings after two passes; ids without ratings have zero rows."""
    return both_factors(ratings_fit(rating_rows(spark, folder), 2))


@query
def nmf_fit_rank16(spark, folder):
    """One pass at a rank whose Gram matrices are summed by batch kernels."""
    return both_factors(ratings_fit(rating_rows(spark, folder), 1, 16))


@query
def nmf_fit_hot(spark, folder):
    """One pass with every id of more than a few cells dealt over its whole stripe."""
    return both_factors(ratings_fit(rating_rows(spark, folder), 1, hot=60))


@query
def nmf_fit_resumed(spark, folder):
    """A fit that is stopped after its first pass and taken up again."""
    record, cells = scratch_path(spark, "passes"), scratch_path(spark, "cells")
    # both runs read the summed ratings from one table
    entry.sum_duplicates(rating_rows(spark, folder)).write.parquet(cells)
    summed = spark.read.parquet(cells)
    ratings_fit(summed, 1, unique=True, record=record)
    return both_factors(ratings_fit(summed, 2, unique=True, record=record))


@query
def nmf_fit_occurring(spark, folder):
    """One pass over ratings with far ids: only ids that occur have rows, and start by their number."""
    far = rating_rows(spark, folder).select(
        (F.col("i") * F.lit(1_000_000_007) + 5).alias("i"), (F.col("j") * F.lit(70_001)).alias("j"), "v"
    )
    return both_factors(nmf.fit(far, RANK, 1, ids="occurring", uniform=formula_uniform))


@query
def nmf_objective(spark, folder):
    """Squared error of the start factors."""
    layout = nmf.Ratings(rating_rows(spark, folder))
    try:
        value = nmf.objective(layout, **start_factors(spark, folder, RANK), rank=RANK)
    finally:
        layout.release()
    return rounded(spark.createDataFrame([(value / 1e6,)], "error double"), "error", places=3)


@query
def fit_summary(spark, folder):
    return report.fit_summary(rating_rows(spark, folder), ratings_fit(rating_rows(spark, folder), 1), *RATINGS)


# --- classifier: coding, layout, stacks ---------------------------------------------------------


@query
def one_hot_labels(spark, folder):
    coded = samples(spark, folder).select("vec_id", one_hot(F.col("label"), LAYERS[-1]).alias("t"))
    return coded.select("vec_id", F.posexplode("t").alias("k", "t"))


@query
def argmax_label(spark, folder):
    return samples(spark, folder).select(
        "vec_id",
        argmax(one_hot(F.col("label"), LAYERS[-1])).alias("decoded"),
        argmax(F.col("features").cast("array<double>")).alias("peak"),
    )


def data_layers(spark, folder) -> list[int]:
    """Input and output width of the network, read off the samples."""
    row = samples(spark, folder).agg(F.max(F.size("features")), F.max("label") + 1).first()
    return [row[0], LAYERS[1], row[1]]


@query
def topology_layout(spark, folder):
    return network.topology_layout(spark, data_layers(spark, folder))


@query
def weight_init(spark, folder):
    """Starting weights by place in the network, by a rule that SQL can repeat."""
    weights = network.initial_weights(spark, data_layers(spark, folder), 11, formula_uniform)
    return rounded(weights.select("pos", "layer", "out", "in", "w"), "w")


def stacked(spark, folder) -> DataFrame:
    pairs = samples(spark, folder).select(
        "vec_id",
        F.col("features").cast("array<double>").alias("features"),
        one_hot(F.col("label"), LAYERS[-1]).alias("target"),
    )
    return stack.stack_rows(stack.assign_stacks(pairs, STACK, "vec_id"))


@query
def stack_rows(spark, folder):
    stacks = stacked(spark, folder)
    parts = [
        stacks.select("stack_id", "n", F.lit(name).alias("part"), F.posexplode(column).alias("pos", "v"))
        for name, column in (("input", "inputs"), ("target", "targets"))
    ]
    return rounded(parts[0].unionAll(parts[1]), "v")


@query
def unstack_rows(spark, folder):
    rows = stack.unstack_rows(stacked(spark, folder))
    return rounded(
        rows.select("stack_id", "stack_pos", argmax(F.col("target")).alias("label"),
                    F.posexplode("features").alias("f", "v")), "v"
    )


# --- classifier: relational forward and backward ------------------------------------------------


def start_table(spark) -> DataFrame:
    return network.weights_table(spark, start_weights(), LAYERS)


def chain_of(spark, folder) -> list[DataFrame]:
    inputs = network.feature_entries(samples(spark, folder), "vec_id")
    return network.forward(inputs, start_table(spark), LAYERS)


def targets_of(spark, folder) -> DataFrame:
    return samples(spark, folder).select(F.col("vec_id").alias("i"), "label", F.lit(1.0).alias("share"))


@query
def mlp_affine(spark, folder):
    inputs = network.feature_entries(samples(spark, folder), "vec_id")
    return rounded(network.affine(inputs, network.layer_matrix(start_table(spark), 1), *LAYERS[:2]), "v")


@query
def mlp_sigmoid(spark, folder):
    inputs = network.feature_entries(samples(spark, folder), "vec_id")
    scores = network.affine(inputs, network.layer_matrix(start_table(spark), 1), *LAYERS[:2])
    return rounded(network.activate(scores), "v")


@query
def mlp_forward(spark, folder):
    return rounded(chain_of(spark, folder)[-1], "v")


@query
def mlp_softmax(spark, folder):
    return rounded(network.softmax(chain_of(spark, folder)[-1]).select("i", "j", "p"), "p")


def backward_of(spark, folder) -> network.Pass:
    return network.backward(
        chain_of(spark, folder), targets_of(spark, folder), start_table(spark), LAYERS
    )


@query
def mlp_loss(spark, folder):
    sums = backward_of(spark, folder).losses.agg(
        F.sum("loss").alias("loss_sum"), F.count("*").alias("n"), F.avg("loss").alias("mean_loss")
    )
    return rounded(sums, "loss_sum", "mean_loss")


@query
def mlp_delta(spark, folder):
    deltas = backward_of(spark, folder).deltas
    tables = [deltas[level].select(F.lit(level).alias("layer"), "i", "j", "v") for level in (1, 2)]
    return rounded(tables[0].unionAll(tables[1]), "v")


@query
def mlp_gradient(spark, folder):
    """Gradient of the mean loss over all rows, by joins."""
    n = samples(spark, folder).count()
    sums = backward_of(spark, folder).gradient
    return rounded(sums.withColumn("g", F.col("g") / n), "g")


# --- classifier: batch kernels and fits ---------------------------------------------------------


def training_data(spark, folder, averaging: str = "stack") -> training.TrainingData:
    return training.prepare(
        samples(spark, folder), stack_size=STACK, averaging=averaging, order_by="vec_id"
    )


def mlp_fit(spark, folder, iterations: int, averaging: str = "stack") -> training.MlpModel:
    return training.fit_mlp(
        samples(spark, folder), LAYERS, settings=training.SgdSettings(STEP, iterations),
        stack_size=STACK, averaging=averaging, order_by="vec_id", initial_weights=start_weights(),
    )


@query
def mlp_gradient_blocked(spark, folder):
    """Mean of the stacks' mean gradients, by batch kernels."""
    data = training_data(spark, folder)
    try:
        total, _, n = training.sum_gradient(data, training.network_gradient(LAYERS), start_weights())
    finally:
        data.release()
    table_ = network.weights_table(spark, total / n, LAYERS).withColumnRenamed("w", "g")
    return rounded(table_, "g")


@query
def mlp_sgd_step(spark, folder):
    return rounded(mlp_fit(spark, folder, 1).weights_table(spark), "w")


@query
def mlp_sgd_fit_2iter(spark, folder):
    return rounded(mlp_fit(spark, folder, 2).weights_table(spark), "w")


@query
def mlp_sgd_fraction_step(spark, folder):
    """One step over about half of the stacks, drawn by a rule that SQL can repeat."""
    data = training.prepare(samples(spark, folder), stack_size=STACK, order_by="vec_id", fraction=0.5)
    try:
        weights, _ = training.run_sgd(
            data, start_weights(), training.network_gradient(LAYERS),
            settings=training.SgdSettings(STEP, 1, fraction=0.5), draw=formula_uniform,
        )
    finally:
        data.release()
    return rounded(network.weights_table(spark, weights, LAYERS), "w")


@query
def mlp_sgd_fraction_fit(spark, folder):
    """Three steps, each over about half of the groups of stacks, drawn by a rule that SQL can repeat; others are not read."""
    settings = training.SgdSettings(STEP, 3, fraction=0.5, groups=GROUPS)
    data = training.prepare(samples(spark, folder), stack_size=STACK, order_by="vec_id", fraction=settings.fraction, groups=settings.groups)
    weights, _ = training.run_sgd(data, start_weights(), training.network_gradient(LAYERS), settings=settings, draw=formula_uniform)
    return rounded(network.weights_table(spark, weights, LAYERS), "w")


@query
def mlp_sgd_row_fit_2iter(spark, folder):
    return rounded(mlp_fit(spark, folder, 2, "row").weights_table(spark), "w")


@query
def mlp_relational_fit_2iter(spark, folder):
    """Two steps with the weights kept as a table, for models too large to broadcast."""
    weights, _ = training.fit_mlp_relational(
        samples(spark, folder), LAYERS, key="vec_id", iterations=2, step=STEP, initial=start_table(spark)
    )
    return rounded(weights, "w")


@query
def mlp_relational_fraction_step(spark, folder):
    """One step of the blocked weights over about half of the groups, drawn by the same rule."""
    weights, _ = training.fit_mlp_relational(
        samples(spark, folder), LAYERS, key="vec_id", settings=training.SgdSettings(STEP, 1, fraction=0.5),
        averaging="stack", stack_size=STACK, initial=start_table(spark), draw=formula_uniform,
    )
    return rounded(weights, "w")


def blocked_fit(spark, folder, **options):
    return training.fit_mlp(
        samples(spark, folder), LAYERS, layout="blocks", order_by="vec_id", stack_size=STACK,
        initial_weights=start_weights(), **options,
    )


@query
def mlp_blocked_sgd_fit(spark, folder):
    """The same call as for small models, with the weights in blocks: two steps over the stacks' means."""
    model = blocked_fit(spark, folder, settings=training.SgdSettings(STEP, 2))
    return rounded(model.weights_table(spark), "w")


@query
def mlp_blocked_predict(spark, folder):
    """Classes by a model whose weights are blocks."""
    model = blocked_fit(spark, folder, settings=training.SgdSettings(STEP, 0))
    return model.predict(samples(spark, folder), "vec_id")


#: Values of a vector in one row of its table.
SLOT = 16


@query
def lbfgs_relational(spark, folder):
    """The embeddings' mean, found by L-BFGS over tables as the least point of weighted squared distances."""
    rows = samples(spark, folder).select(F.posexplode("features").alias("f", "x"))
    # sums of x and of x squared are all that the squared distances need
    facts = cut(rows.groupBy("f").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("double")).alias("x")))
    weight = F.col("f") % 3 + 1

    def cost(point: DataFrame):
        cells = point.select((F.col("slot") * SLOT).alias("first"), F.posexplode("v").alias("k", "w"))
        met = cells.withColumn("f", F.col("first") + F.col("k")).join(facts, "f")
        part = cut(met.select(
            "first", "k", (weight * (F.col("w") - F.col("x") / F.col("n"))).alias("g"),
            (weight * F.col("w") * (F.col("w") / 2 - F.col("x") / F.col("n"))).alias("c"),
        ))
        listed = part.groupBy((F.col("first") / SLOT).cast("bigint").alias("slot")).agg(F.array_sort(F.collect_list(F.struct("k", "g"))).alias("c"))
        return part.agg(F.sum("c")).first()[0], listed.select("slot", F.col("c.g").alias("v"))

    width = samples(spark, folder).agg(F.max(F.size("features"))).first()[0]
    ids = spark.range(-(-width // SLOT)).withColumn("n", F.least(F.lit(SLOT), F.lit(width) - F.col("id") * SLOT).cast("int"))
    start = ids.select(F.col("id").alias("slot"), F.expr("array_repeat(1D, n)").alias("v"))
    found, _ = table_lbfgs.minimise(start, cost, tol=1e-12, iterations=15)
    cells = found.select((F.col("slot") * SLOT).alias("first"), F.posexplode("v").alias("k", "w"))
    return rounded(cells.select((F.col("first") + F.col("k")).alias("f"), "w"), "w", places=4)


@query
def loss_history(spark, folder):
    history = mlp_fit(spark, folder, 2).loss_history(spark)
    return rounded(history, "loss_sum", "n", "mean_loss")


@query
def weight_norm(spark, folder):
    after = mlp_fit(spark, folder, 1).weights_table(spark)
    return rounded(network.weight_change(start_table(spark), after, 1e-3), "change", "size")


def scored(spark, folder) -> DataFrame:
    return scoring.add_scores(samples(spark, folder), start_weights(), LAYERS)


@query
def mlp_raw_scores(spark, folder):
    rows = scored(spark, folder).select("vec_id", F.posexplode("rawPrediction").alias("k", "v"))
    return rounded(rows, "v")


@query
def mlp_probability(spark, folder):
    rows = scored(spark, folder).select("vec_id", F.posexplode("probability").alias("k", "p"))
    return rounded(rows, "p")


@query
def mlp_predict(spark, folder):
    rows = scoring.add_prediction(samples(spark, folder), start_weights(), LAYERS)
    return rows.select("vec_id", "label", "prediction")


@query
def mlp_predict_relational(spark, folder):
    return scoring.score_relational(samples(spark, folder), start_table(spark), LAYERS, "vec_id")


@query
def mlp_accuracy(spark, folder):
    rows = scoring.add_prediction(samples(spark, folder), start_weights(), LAYERS)
    return rounded(scoring.accuracy(rows), "accuracy")


@query
def train_accuracy(spark, folder):
    rows = samples(spark, folder)
    return rounded(report.train_accuracy(rows, mlp_fit(spark, folder, 2)), "train_accuracy")


@query
def hash_sample(spark, folder):
    """About 30 % of the samples, drawn without replacement by a rule that SQL can repeat."""
    rule = F.pmod(F.col("vec_id") % 1_000_003 * 7919 + 43 * 104_729, F.lit(1_000_003)) / F.lit(1_000_003.0)
    return training.key_sample(samples(spark, folder), "vec_id", 0.3, seed=43, rule=rule).select("vec_id")


@query
def mlp_lbfgs_fit(spark, folder):
    """Loss after each of up to eight L-BFGS iterations."""
    model = training.fit_mlp(
        samples(spark, folder), LAYERS, solver="l-bfgs",
        settings=training.LbfgsSettings(iterations=8), averaging="row",
        initial_weights=start_weights(),
    )
    return model.loss_history(spark)


def least_squares(batch: pa.RecordBatch, weights: np.ndarray):
    """Gradient of half the squared error of a linear fit to the label."""
    x = arrow.to_matrix(batch.column("features"))
    gap = x @ weights - batch.column("label").to_numpy()
    return gap @ x, float(gap @ gap) / 2.0, float(len(gap))


@query
def lbfgs_least_squares(spark, folder):
    """Slope and intercept of the label over the first component, found by L-BFGS."""
    line = samples(spark, folder).select(F.array(F.col("features")[0].cast("double"), F.lit(1.0)).alias("features"), "label")
    data = training.prepare(line, averaging="row")
    try:
        weights, _ = training.run_lbfgs(data, np.zeros(2), least_squares, settings=training.LbfgsSettings(tol=1e-12))
    finally:
        data.release()
    return rounded(spark.createDataFrame(pa.table({"f": np.arange(2), "w": weights})), "w", places=4)


def shrinking_step(weights, gradient, step, iteration, reg):
    """A step that falls with the square root of the iteration, with a ridge penalty."""
    now = step / np.sqrt(iteration)
    moved = weights * (1.0 - now * reg) - now * gradient
    return moved, 0.5 * reg * float(moved @ moved)


def linear_fit(spark, folder, updater, reg: float) -> DataFrame:
    data = training_data(spark, folder, "row")
    try:
        weights, _ = training.run_sgd(
            data, np.arange(LAYERS[0]) / float(LAYERS[0]), least_squares, updater,
            training.SgdSettings(step=0.5, iterations=2, reg=reg),
        )
    finally:
        data.release()
    return rounded(spark.createDataFrame(pa.table({"f": np.arange(LAYERS[0]), "w": weights})), "w")


@query
def custom_gradient(spark, folder):
    return linear_fit(spark, folder, training.plain_step, 0.0)


@query
def custom_updater(spark, folder):
    return linear_fit(spark, folder, shrinking_step, 0.1)


# --- files --------------------------------------------------------------------------------------


@query
def csv_roundtrip(spark, folder):
    """Ratings written as CSV and read back."""
    path = scratch_path(spark, "ratings")
    rating_files.write_ratings(rating_rows(spark, folder), path)
    read = rating_files.rating_entries(rating_files.read_ratings(spark, path))
    return rounded(entry.sum_duplicates(read), "v")


@query
def libsvm_roundtrip(spark, folder):
    """Samples written as libsvm text, read back and coded as training pairs."""
    path = scratch_path(spark, "samples")
    libsvm.write_libsvm(samples(spark, folder), path)
    pairs = libsvm.training_pairs(libsvm.read_libsvm(spark, path, LAYERS[0]), LAYERS[-1])
    rows = pairs.select(
        argmax(F.col("target")).alias("label"), F.posexplode("features").alias("f", "x")
    )
    sums = rows.groupBy("label", "f").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    return rounded(sums, "x")
