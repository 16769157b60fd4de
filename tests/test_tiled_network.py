import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.functions.columns import hash_uniform
from blockweave.operators import block
from blockweave.plans import network, tiled_network, training
from blockweave.plans.training import SgdSettings
from tests.test_network import LAYERS, data, table, weights_of


def ridge(weights, gradient, step, iteration, reg):
    after = weights * (1.0 - step * reg) - step * gradient
    return after, 0.5 * reg * float(after @ after)


@pytest.mark.parametrize("unit_block", [2, 1024])
def test_blocked_fit_equals_kernel_fit(spark, monkeypatch, unit_block):
    monkeypatch.setattr(block, "BROADCAST_BYTES", 0 if unit_block == 2 else 1 << 20)
    x, y = data()
    w = weights_of()
    df = table(spark, x, y)
    settings = SgdSettings(0.5, 2, reg=0.1)
    ours = training.fit_mlp(df, LAYERS, settings=settings, averaging="row", initial_weights=w, updater=ridge)
    weights, history = training.fit_mlp_relational(
        df, LAYERS, key="id", settings=settings, updater=ridge, initial=network.weights_table(spark, w, LAYERS), stack_size=7, unit_block=unit_block
    )
    assert np.allclose(network.weights_vector(weights, LAYERS), ours.weights)
    assert [s.mean_loss for s in history] == pytest.approx([s.mean_loss for s in ours.history])


def test_stacks_and_fraction_are_those_of_the_other_path(spark):
    x, y = data()
    w = weights_of()
    df = table(spark, x, y)
    settings = SgdSettings(0.5, 3, fraction=0.5)
    ours = training.fit_mlp(df, LAYERS, settings=settings, stack_size=4, order_by="id", initial_weights=w)
    weights, history = training.fit_mlp_relational(
        df, LAYERS, key="id", settings=settings, averaging="stack", stack_size=4, initial=network.weights_table(spark, w, LAYERS),
        draw=lambda place, seed: hash_uniform(place.cast("bigint"), seed=seed),
    )
    assert np.allclose(network.weights_vector(weights, LAYERS), ours.weights)
    assert [(s.iteration, s.n) for s in history] == [(s.iteration, pytest.approx(s.n)) for s in ours.history]


def test_tolerance_ends_the_fit(spark):
    x, y = data()
    _, history = training.fit_mlp_relational(table(spark, x, y), LAYERS, key="id", settings=SgdSettings(1e-6, 5, tol=0.5))
    assert len(history) == 1


def test_no_row_for_a_pair_of_units(spark):
    x, y = data()
    samples = tiled_network.prepare(table(spark, x, y), LAYERS, key="id", group=8)
    weights = tiled_network.start_blocks(spark, LAYERS, samples.shape, 11, None)
    result = tiled_network.sum_gradient(samples, weights)
    plan = result.gradient._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "posexplode" not in plan
    # rows of a pass are blocks: the weights' own, not one for each weight
    assert result.gradient.count() == weights.count() < network.weight_cells(spark, LAYERS).count() / 4
    result.release()
    samples.release()


def test_group_sizes_and_empty_table(spark):
    assert tiled_network.group_size([10, 3], 128) == 128
    assert tiled_network.group_size([1 << 21, 3], 128) == 1
    shape = tiled_network.Shape((5000, 3000, 700), 128)
    assert shape.side(2) == 700 and shape.side(1) == 1024
    with pytest.raises(ValueError, match="stack of 128"):
        tiled_network.prepare(spark.range(1), [1 << 20, 2], key="id", averaging="stack")
    x, y = data()
    weights, history = training.fit_mlp_relational(table(spark, x, y).limit(0), LAYERS, key="id", iterations=2)
    assert history == [] and weights.count() == network.weight_cells(spark, LAYERS).count()
    again = tiled_network.to_blocks(weights, tiled_network.Shape(tuple(LAYERS), 8))
    back = tiled_network.to_table(again, tiled_network.Shape(tuple(LAYERS), 8))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, weights.select(*back.columns).collect()))


def test_one_call_for_both_layouts(spark, monkeypatch):
    x, y = data()
    w = weights_of()
    df = table(spark, x, y)
    options = {"settings": SgdSettings(0.5, 2, tol=1e-9), "stack_size": 4, "order_by": "id", "initial_weights": w}
    small = training.fit_mlp(df, LAYERS, **options)
    large = training.fit_mlp(df, LAYERS, layout="blocks", **options)
    assert np.allclose(network.weights_vector(large.weights_table(spark), LAYERS), small.weights)
    classes = {r["id"]: r["prediction"] for r in large.predict(df, "id").collect()}
    assert classes == {r["id"]: r["prediction"] for r in small.transform(df).collect()}
    monkeypatch.setattr(training, "BROADCAST_BYTES", 8)
    picked = training.fit_mlp(df, LAYERS, settings=SgdSettings(0.5, 1), averaging="row")
    assert isinstance(picked, tiled_network.BlockedModel) and picked.loss_history(spark).count() == 1
    with pytest.raises(ValueError, match="need labels"):
        training.fit_mlp(df, LAYERS, layout="blocks", target="t")
    with pytest.raises(ValueError, match="layout must be"):
        training.fit_mlp(df, LAYERS, layout="rows")


def test_lbfgs_on_blocks_goes_the_same_way(spark):
    x, y = data()
    df, w = table(spark, x, y), weights_of()
    options = {"solver": "l-bfgs", "settings": training.LbfgsSettings(iterations=2), "averaging": "row", "initial_weights": w}
    small = training.fit_mlp(df, LAYERS, **options)
    large = training.fit_mlp(df, LAYERS, layout="blocks", order_by="id", **options)
    assert [s.mean_loss for s in large.history] == pytest.approx([s.mean_loss for s in small.history])
    assert np.allclose(network.weights_vector(large.weights_table(spark), LAYERS), small.weights)
