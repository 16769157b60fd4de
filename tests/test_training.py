import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from blockweave.functions import arrow, kernels
from blockweave.operators import stack
from blockweave.plans import network, training
from blockweave.plans.training import LbfgsSettings, SgdSettings
from tests.test_network import LAYERS, coded, data, table, weights_of


def stack_mean(w, x, y, size):
    parts = [kernels.gradient(w, LAYERS, x[a : a + size], coded(y[a : a + size]),
                              np.full(len(x[a : a + size]), 1 / len(x[a : a + size])))
             for a in range(0, len(x), size)]
    return np.mean([p[0] for p in parts], axis=0), np.mean([p[1] for p in parts])


@pytest.mark.parametrize("size", [1, 4, 7, 100])
@pytest.mark.parametrize("partitions", [1, 5])
def test_ordered_stacks_do_not_depend_on_partitions(spark, size, partitions):
    x, y = data()
    w = weights_of()
    prepared = training.prepare(table(spark, x, y, partitions), stack_size=size, order_by="id")
    total, loss, n = training.sum_gradient(prepared, training.network_gradient(LAYERS), w)
    want, mean_loss = stack_mean(w, x, y, size)
    assert n == pytest.approx(-(-len(x) // size))
    assert np.allclose(total / n, want) and loss / n == pytest.approx(mean_loss)
    prepared.release()


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_stacks_across_arrow_batches(spark, batch):
    x, y = data()
    w = weights_of()
    df = table(spark, x, y, 1).coalesce(1).sortWithinPartitions("id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        prepared = training.prepare(df, stack_size=5)
        total, _, n = training.sum_gradient(prepared, training.network_gradient(LAYERS), w)
        prepared.release()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert n == pytest.approx(5)
    assert np.allclose(total / n, stack_mean(w, x, y, 5)[0])


def test_row_average_does_not_depend_on_partitions(spark):
    x, y = data()
    w = weights_of()
    want = kernels.gradient(w, LAYERS, x, coded(y), np.full(len(x), 1 / len(x)))[0]
    for partitions in (1, 4):
        prepared = training.prepare(table(spark, x, y, partitions), averaging="row")
        total, _, n = training.sum_gradient(prepared, training.network_gradient(LAYERS), w)
        assert n == len(x) and np.allclose(total / n, want)
        prepared.release()


def test_many_partitions_use_a_tree(spark, monkeypatch):
    from blockweave.operators import reduce

    monkeypatch.setattr(reduce, "DIRECT_PARTIALS", 2)
    x, y = data(40)
    w = weights_of()
    prepared = training.prepare(table(spark, x, y, 9), averaging="row")
    assert prepared.parts > 2
    total, _, n = training.sum_gradient(prepared, training.network_gradient(LAYERS), w)
    assert n == 40
    assert np.allclose(total, kernels.gradient(w, LAYERS, x, coded(y), np.ones(40))[0])
    prepared.release()


def test_stack_and_unstack(spark):
    x, y = data()
    df = table(spark, x, y).select(
        "id", "features", F.expr("transform(sequence(0, 2), k -> cast(k = label as double))").alias("target")
    )
    assigned = stack.assign_stacks(df, 6, "id")
    for r in assigned.collect():
        assert r["stack_id"] == r["id"] // 6 and r["stack_pos"] == r["id"] % 6
        assert r["stack_n"] == (6 if r["id"] < 18 else 5)
    stacks = stack.stack_rows(assigned)
    for r in stacks.collect():
        a = r["stack_id"] * 6
        assert r["inputs"] == x[a : a + 6].reshape(-1).tolist()
        assert r["targets"] == coded(y[a : a + 6]).reshape(-1).tolist()
    back = stack.unstack_rows(stacks).collect()
    assert len(back) == len(x)
    for r in back:
        n = r["stack_id"] * 6 + r["stack_pos"]
        assert r["features"] == x[n].tolist() and r["target"] == coded(y)[n].tolist()


def test_stacks_inside_partitions(spark):
    x, y = data()
    rows = stack.assign_stacks(table(spark, x, y, 3), 4).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["stack_id"], []).append((r["stack_pos"], r["stack_n"]))
    assert sum(len(v) for v in sizes.values()) == len(x)
    for v in sizes.values():
        assert sorted(p for p, _ in v) == list(range(len(v)))
        assert {n for _, n in v} == {len(v)}
    with pytest.raises(ValueError):
        stack.assign_stacks(table(spark, x, y), 0)


def test_relational_fit_equals_kernel_fit(spark):
    x, y = data()
    w = weights_of()
    df = table(spark, x, y)
    ours = training.fit_mlp(
        df, LAYERS, settings=SgdSettings(0.5, 2), averaging="row", initial_weights=w
    )
    weights, history = training.fit_mlp_relational(
        df, LAYERS, key="id", iterations=2, step=0.5, initial=network.weights_table(spark, w, LAYERS)
    )
    assert np.allclose(network.weights_vector(weights, LAYERS), ours.weights)
    assert [s.mean_loss for s in history] == pytest.approx([s.mean_loss for s in ours.history])


def test_targets_and_vectors_as_input(spark):
    x, y = data()
    w = weights_of()
    df = table(spark, x, y)
    options = {"settings": SgdSettings(0.5, 1), "averaging": "row", "initial_weights": w}
    want = training.fit_mlp(df, LAYERS, **options).weights
    pairs = df.withColumn("t", F.expr("transform(sequence(0, 2), k -> cast(k = label as double))"))
    assert np.allclose(training.fit_mlp(pairs, LAYERS, target="t", **options).weights, want)
    vectors = df.withColumn("features", array_to_vector("features"))
    assert np.allclose(training.fit_mlp(vectors, LAYERS, **options).weights, want)
    cached = df.cache()
    assert np.allclose(training.fit_mlp(cached, LAYERS, **options).weights, want)
    assert cached.is_cached
    cached.unpersist()


def test_label_out_of_range_stops(spark):
    x, y = data()
    y[3] = 3
    with pytest.raises(PySparkException, match="label out of range"):
        training.fit_mlp(table(spark, x, y), LAYERS, settings=SgdSettings(iterations=1))


def test_wrong_width_stops(spark):
    x, y = data()
    with pytest.raises(ValueError, match="expected 6 features"):
        training.fit_mlp(table(spark, x, y), [6, 3], settings=SgdSettings(iterations=1))
    uneven = table(spark, x, y).withColumn("features", F.expr("slice(features, 1, 3 + id % 2)"))
    with pytest.raises(ValueError, match="between 3 and 4"):
        training.prepare(uneven)


@pytest.mark.parametrize("solver", ["sgd", "l-bfgs"])
def test_empty_input_returns_the_start(spark, solver):
    x, y = data()
    w = weights_of()
    empty = table(spark, x, y).where("id < 0")
    model = training.fit_mlp(empty, LAYERS, solver=solver, initial_weights=w)
    assert np.array_equal(model.weights, w) and model.history == []
    assert model.loss_history(spark).count() == 0
    ordered = training.fit_mlp(empty, LAYERS, solver=solver, initial_weights=w, order_by="id")
    assert np.array_equal(ordered.weights, w)


def test_warm_start_does_not_change_the_callers_vector(spark):
    x, y = data()
    w = weights_of()
    kept = w.copy()
    df = table(spark, x, y)
    options = {"averaging": "row"}
    two = training.fit_mlp(df, LAYERS, settings=SgdSettings(0.5, 2), initial_weights=w, **options)
    assert np.array_equal(w, kept)
    one = training.fit_mlp(df, LAYERS, settings=SgdSettings(0.5, 1), initial_weights=w, **options)
    then = training.fit_mlp(df, LAYERS, settings=SgdSettings(0.5, 1), initial_weights=one.weights, **options)
    assert np.allclose(then.weights, two.weights)
    with pytest.raises(ValueError, match="expected a weight vector of size 39"):
        training.fit_mlp(df, LAYERS, initial_weights=w[:-1])


def test_stop_rule(spark):
    x, y = data()
    df = table(spark, x, y)
    tiny = SgdSettings(step=1e-9, iterations=5, tol=1e-3)
    assert len(training.fit_mlp(df, LAYERS, settings=tiny).history) == 1
    never = SgdSettings(step=1e-9, iterations=3)
    assert len(training.fit_mlp(df, LAYERS, settings=never).history) == 3


def test_sampling_takes_whole_stacks_and_may_take_none(spark):
    x, y = data(60)
    df = table(spark, x, y)
    settings = SgdSettings(0.1, 6, fraction=0.5)
    a = training.fit_mlp(df, LAYERS, settings=settings, stack_size=4, order_by="id", seed=2)
    b = training.fit_mlp(df.repartition(5), LAYERS, settings=settings, stack_size=4, order_by="id", seed=2)
    assert np.allclose(a.weights, b.weights)
    counts = [s.n for s in a.history]
    assert np.allclose(counts, np.round(counts)) and len(set(np.round(counts))) > 1
    assert max(counts) < 15
    rare = training.fit_mlp(df, LAYERS, settings=SgdSettings(0.1, 3, fraction=1e-6), stack_size=4)
    assert rare.history == []
    rows = training.fit_mlp(df, LAYERS, settings=SgdSettings(0.1, 4, fraction=0.5), averaging="row")
    assert all(0 < s.n < 60 for s in rows.history)


@pytest.mark.parametrize("averaging", ["stack", "row"])
def test_groups_are_drawn_whole_and_others_not_read(spark, averaging):
    x, y = data(90)
    w = weights_of()
    df = table(spark, x, y)
    prepared = training.prepare(df, stack_size=4, averaging=averaging, order_by="id", fraction=0.5, groups=6)
    gradient = training.network_gradient(LAYERS)
    whole = training.prepare(df, stack_size=4, averaging=averaging, order_by="id")
    assert (prepared.count, prepared.width) == (90, whole.width)
    # groups drawn one by one add up to the whole
    parts = [
        training.sum_gradient(prepared, gradient, w, 0.5, 0, lambda i, seed, g=g: F.when(i == g, 0.0).otherwise(1.0))
        for g in range(6)
    ]
    total, loss, n = training.sum_gradient(whole, gradient, w)
    assert np.allclose(sum(p[0] for p in parts), total)
    assert sum(p[1] for p in parts) == pytest.approx(loss) and sum(p[2] for p in parts) == pytest.approx(n)
    assert all(p[2] > 0 for p in parts)
    if averaging == "stack":
        assert [round(p[2]) for p in parts] == [4, 4, 4, 4, 4, 3]
    drawn = prepared.drawn(0.5, 43, lambda i, seed: F.when(i < 2, 0.0).otherwise(1.0))
    files = lambda rows: {r["f"] for r in rows.select(F.input_file_name().alias("f")).collect()}
    assert files(drawn) < files(prepared.rows) and all("_group=0" in f or "_group=1" in f for f in files(drawn))
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_group" in plan.split("PartitionFilters: [")[1].split("]")[0]
    whole.release()


def test_fit_by_groups(spark):
    x, y = data(60)
    df = table(spark, x, y)
    settings = SgdSettings(0.1, 6, fraction=0.5, groups=5)
    a = training.fit_mlp(df, LAYERS, settings=settings, stack_size=4, order_by="id", seed=2)
    b = training.fit_mlp(df.repartition(5), LAYERS, settings=settings, stack_size=4, order_by="id", seed=2)
    assert np.allclose(a.weights, b.weights) and all(s.n < 15.5 for s in a.history)
    # copies of a row lie in one group; nothing is lost
    copies = df.limit(1).crossJoin(spark.range(50).select(F.lit(1).alias("copy"))).drop("copy")
    prepared = training.prepare(copies, averaging="row", fraction=0.5, groups=5)
    assert prepared.count == 50
    w = weights_of()
    nothing = training.fit_mlp(df.limit(0), LAYERS, settings=settings, stack_size=4, initial_weights=w)
    assert nothing.history == [] and np.allclose(nothing.weights, w)
    rare = training.fit_mlp(df, LAYERS, settings=SgdSettings(0.1, 2, fraction=1e-6, groups=5), stack_size=4)
    assert rare.history == []
    with pytest.raises(ValueError):
        SgdSettings(fraction=0.5, groups=10**6)


def test_key_sample(spark):
    df = spark.range(20_000)
    got = training.key_sample(df, "id", 0.3, 5)
    again = training.key_sample(df.repartition(7), "id", 0.3, 5)
    assert abs(got.count() / 20_000 - 0.3) < 0.05
    assert got.exceptAll(again).count() == 0 and got.distinct().count() == got.count()


def test_custom_gradient_and_updater(spark):
    x, y = data()
    df = table(spark, x, y)

    def squared(batch, w):
        m = arrow.to_matrix(batch.column("features"))
        gap = m @ w - batch.column("label").to_numpy()
        return gap @ m, float(gap @ gap) / 2, float(len(gap))

    def ridge(w, g, step, iteration, reg):
        new = w * (1 - step * reg) - step * g
        return new, 0.5 * reg * float(new @ new)

    prepared = training.prepare(df, averaging="row")
    w0 = np.zeros(5)
    got, history = training.run_sgd(prepared, w0, squared, ridge, SgdSettings(0.1, 3, reg=0.2))
    w, penalty = w0, 0.0
    for s in history:
        gap = x @ w - y
        assert s.mean_loss == pytest.approx(gap @ gap / 2 / len(y) + penalty)
        w, penalty = ridge(w, gap @ x / len(y), 0.1, 1, 0.2)
    assert np.allclose(got, w)
    best, _ = training.run_lbfgs(prepared, w0, squared, ridge, LbfgsSettings(reg=0.2, tol=1e-10))
    n = len(y)
    exact = np.linalg.solve(x.T @ x / n + 0.2 * np.eye(5), x.T @ y / n)
    assert np.allclose(best, exact, atol=1e-4)
    with pytest.raises(ValueError, match="no penalty"):
        training.run_sgd(prepared, w0, squared, settings=SgdSettings(reg=0.2))
    prepared.release()


def test_lbfgs_reaches_the_loss_of_the_stock_solver(spark):
    x, y = data(60)
    w = weights_of()
    df = table(spark, x, y, 1)
    ours = training.fit_mlp(
        df, LAYERS, solver="l-bfgs", averaging="row", initial_weights=w,
        settings=LbfgsSettings(iterations=25, tol=0.0),
    )
    losses = [s.mean_loss for s in ours.history]
    assert all(b <= a for a, b in zip(losses, losses[1:], strict=False))
    stock = MultilayerPerceptronClassifier(
        layers=LAYERS, solver="l-bfgs", maxIter=25, tol=1e-12, blockSize=60, initialWeights=Vectors.dense(w)
    ).fit(df.select(array_to_vector("features").alias("features"), F.col("label").cast("double")))
    reached = kernels.gradient(stock.weights.toArray(), LAYERS, x, coded(y), np.full(60, 1 / 60))[1]
    assert losses[-1] < losses[0] / 2
    assert losses[-1] < reached + 0.1


@pytest.mark.parametrize(
    "bad",
    [{"step": 0}, {"iterations": -1}, {"reg": -1}, {"fraction": 0}, {"fraction": 1.5}, {"tol": 2}, {"tol": -1}],
)
def test_sgd_settings(bad):
    with pytest.raises(ValueError):
        SgdSettings(**bad)


@pytest.mark.parametrize("bad", [{"corrections": 0}, {"tol": -1}, {"iterations": -1}, {"reg": -1}])
def test_lbfgs_settings(bad):
    with pytest.raises(ValueError):
        LbfgsSettings(**bad)


def test_facade_arguments(spark):
    x, y = data()
    df = table(spark, x, y)
    for options in (
        {"solver": "newton"}, {"settings": LbfgsSettings()}, {"averaging": "all"}, {"stack_size": 0}
    ):
        with pytest.raises(ValueError):
            training.fit_mlp(df, LAYERS, **options)
    default = SgdSettings()
    assert (default.step, default.iterations, default.reg, default.fraction) == (1.0, 100, 0.0, 1.0)
    assert (LbfgsSettings().corrections, LbfgsSettings().tol, LbfgsSettings().iterations) == (10, 1e-6, 200)


def test_one_class_is_learnt(spark):
    x, _ = data(30)
    df = table(spark, x, np.ones(30, dtype=int))
    model = training.fit_mlp(df, LAYERS, settings=SgdSettings(1.0, 15), averaging="row")
    assert model.history[-1].mean_loss < model.history[0].mean_loss
    assert {r["prediction"] for r in model.transform(df).collect()} == {1.0}


@pytest.mark.parametrize(
    "rows,message",
    [
        ([(0, [1.0, 2.0, 3.0], 3.0)], "label out of range"),
        ([(0, [1.0, 2.0, 3.0], None)], "label out of range"),
        ([(0, [1.0, 2.0, 3.0, 4.0], 1.0)], "expected 3 features"),
        ([(0, [1.0, 2.0, 3.0], 1.0), (0, [1.0, 2.0, 3.0], 2.0)], "key of its own"),
        ([(None, [1.0, 2.0, 3.0], 1.0)], "key of its own"),
    ],
)
def test_relational_fit_refuses_bad_samples(spark, rows, message):
    df = spark.createDataFrame(rows, "n bigint, features array<double>, label double")
    with pytest.raises((ValueError, PySparkException), match=message):
        training.fit_mlp_relational(df, [3, 4, 3], key="n", iterations=1)


def test_relational_fit_checks_its_settings(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0], 1.0)], "n bigint, features array<double>, label double")
    for bad in ({"iterations": -1}, {"iterations": 1, "step": 0.0}):
        with pytest.raises(ValueError):
            training.fit_mlp_relational(df, [3, 4, 3], key="n", **bad)


def test_row_samples_do_not_depend_on_partitions(spark):
    df = spark.range(200).select(F.array(F.col("id") * 0.01, F.lit(1.0), F.lit(-1.0)).alias("features"), (F.col("id") % 3).cast("double").alias("label"))
    settings = SgdSettings(0.1, 2, fraction=0.4)
    fits = [training.fit_mlp(df.repartition(n), [3, 4, 3], settings=settings, averaging="row") for n in (1, 5)]
    assert np.allclose(fits[0].weights, fits[1].weights)
    assert [s.n for s in fits[0].history] == [s.n for s in fits[1].history]
