import re

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from blockweave.functions import kernels
from blockweave.plans import network, scoring, training
from blockweave.session import cut
from tests.conftest import matrix_of

RNG = np.random.default_rng(21)
LAYERS = [5, 4, 3]


def data(n=23):
    return RNG.normal(size=(n, LAYERS[0])), RNG.integers(0, LAYERS[-1], size=n)


def table(spark, x, y, partitions=3):
    rows = [(n, [float(v) for v in x[n]], int(y[n])) for n in range(len(x))]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label int").repartition(partitions)


def coded(y):
    return np.eye(LAYERS[-1])[y]


def weights_of(layers=LAYERS):
    return RNG.normal(size=kernels.weight_count(layers))


def test_gradient_is_the_finite_difference():
    layers = [4, 5, 3, 2]
    x, t = RNG.normal(size=(6, 4)), np.eye(2)[RNG.integers(0, 2, 6)]
    w, share = weights_of(layers), RNG.random(6)
    g, _ = kernels.gradient(w, layers, x, t, share)
    for k in range(w.size):
        step = np.zeros_like(w)
        step[k] = 1e-6
        up = kernels.gradient(w + step, layers, x, t, share)[1]
        down = kernels.gradient(w - step, layers, x, t, share)[1]
        assert g[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_loss_stays_finite_for_extreme_scores():
    x, t = np.array([[1e4]]), np.array([[0.0, 1.0]])
    w = np.array([1.0, -1.0, 0.0, 0.0])
    loss = kernels.gradient(w, [1, 2], x, t, np.ones(1))[1]
    assert loss == pytest.approx(2e4)


@pytest.mark.parametrize("hold", [lambda df: df, cut])
def test_relational_pass_equals_kernel(spark, hold):
    layers = [5, 4, 6, 3]
    x, y = data(11)
    w = weights_of(layers)
    share = RNG.random(11)
    samples = table(spark, x, y)
    weights = network.weights_table(spark, w, layers)
    chain = network.forward(network.feature_entries(samples, "id"), weights, layers, hold)
    shares = spark.createDataFrame([(n, float(share[n])) for n in range(11)], "id bigint, share double")
    targets = samples.join(shares, "id").select(F.col("id").alias("i"), "label", "share")
    got = network.backward(chain, targets, weights, layers, hold)
    flat, loss = kernels.gradient(w, layers, x, coded(y), share)
    table_ = got.gradient.withColumnRenamed("g", "w")
    assert np.allclose(network.weights_vector(table_, layers), flat)
    assert got.losses.agg(F.sum("loss")).first()[0] == pytest.approx(loss)
    raw = kernels.forward(w, layers, x)[-1]
    assert np.allclose(matrix_of(chain[-1], (11, 3)), raw)
    p = network.softmax(chain[-1]).select("i", "j", F.col("p").alias("v"))
    assert np.allclose(matrix_of(p, (11, 3)), kernels.softmax(raw)[0])


def test_relational_pass_without_broadcast(spark, monkeypatch):
    """A model above the broadcast limit takes the shuffle joins and gives the same gradient."""
    from blockweave.operators import entry

    monkeypatch.setattr(entry, "BROADCAST_BYTES", 0)
    x, y = data()
    w = weights_of()
    samples, weights = table(spark, x, y), network.weights_table(spark, w, LAYERS)
    chain = network.forward(network.feature_entries(samples, "id"), weights, LAYERS)
    targets = samples.select(F.col("id").alias("i"), "label", F.lit(1.0).alias("share"))
    got = network.backward(chain, targets, weights, LAYERS).gradient.withColumnRenamed("g", "w")
    want = kernels.gradient(w, LAYERS, x, coded(y), np.ones(len(x)))[0]
    assert np.allclose(network.weights_vector(got, LAYERS), want)


def test_weights_table_and_back(spark):
    w = weights_of()
    t = network.weights_table(spark, w, LAYERS)
    assert np.array_equal(network.weights_vector(t, LAYERS), w)
    with pytest.raises(ValueError, match="does not cover"):
        network.weights_vector(t.where("out > 0"), LAYERS)


def test_layout_and_initial_weights(spark):
    layout = [tuple(r) for r in network.topology_layout(spark, [780, 196, 100, 25, 10]).collect()]
    assert layout == [
        (1, 780, 196, 153076, 0), (2, 196, 100, 19700, 153076),
        (3, 100, 25, 2525, 172776), (4, 25, 10, 260, 175301),
    ]
    assert kernels.weight_count([780, 196, 100, 25, 10]) == 175561
    init = network.initial_weights(spark, LAYERS, seed=3)
    flat = network.weights_vector(init, LAYERS)
    places = {r["pos"]: r["w"] for r in init.collect()}
    assert np.array_equal([places[k] for k in range(flat.size)], flat)
    for (m, b), n_in in zip(kernels.unpack(flat, LAYERS), LAYERS, strict=False):
        bound = 2.4 / np.sqrt(n_in)
        assert np.abs(m).max() <= bound and np.abs(b).max() <= bound
    again = network.weights_vector(network.initial_weights(spark, LAYERS, seed=3), LAYERS)
    assert np.array_equal(flat, again)
    with pytest.raises(ValueError):
        network.topology_layout(spark, [3])


def test_scores_keep_other_columns_and_take_vectors(spark):
    x, y = data()
    w = weights_of()
    df = table(spark, x, y)
    raw = kernels.forward(w, LAYERS, x)[-1]
    dense = df.withColumn("features", array_to_vector("features"))
    for rows in (df, dense):
        got = scoring.add_scores(rows, w, LAYERS).orderBy("id").collect()
        assert got[0].asDict().keys() == {
            "id", "features", "label", "rawPrediction", "probability", "prediction"
        }
        assert np.allclose([r["rawPrediction"] for r in got], raw)
        assert np.allclose(np.sum([r["probability"] for r in got], axis=1), 1)
        assert [r["prediction"] for r in got] == raw.argmax(axis=1).tolist()
    by_join = scoring.score_relational(df, network.weights_table(spark, w, LAYERS), LAYERS, "id")
    assert [r["prediction"] for r in by_join.orderBy("i").collect()] == raw.argmax(axis=1).tolist()
    hit = (raw.argmax(axis=1) == y).mean()
    row = scoring.accuracy(scoring.add_prediction(df, w, LAYERS)).first()
    assert (row["n"], row["accuracy"]) == (len(x), pytest.approx(hit))


def test_scores_of_sparse_vectors(spark):
    rows = [(0, Vectors.sparse(5, [1, 4], [2.0, -1.0])), (1, Vectors.dense([0, 2.0, 0, 0, -1.0]))]
    w = weights_of()
    got = scoring.add_scores(spark.createDataFrame(rows, ["id", "features"]), w, LAYERS).collect()
    assert got[0]["rawPrediction"] == pytest.approx(got[1]["rawPrediction"])


def test_weight_change(spark):
    a, b = weights_of(), weights_of()
    ta, tb = (network.weights_table(spark, v, LAYERS) for v in (a, b))
    row = network.weight_change(ta, tb, 1e-3).first()
    assert row["change"] == pytest.approx(np.linalg.norm(a - b))
    assert row["size"] == pytest.approx(np.linalg.norm(b))
    assert not row["converged"]
    assert network.weight_change(ta, ta, 1e-3).first()["converged"]


@pytest.mark.parametrize("steps", [1, 3])
def test_gradient_descent_equals_the_stock_classifier(spark, steps):
    """Mean of stack means over one partition, last stack shorter than the others."""
    x, y = data(50)
    w = weights_of()
    df = table(spark, x, y, 1).coalesce(1).sortWithinPartitions("id")
    stock = MultilayerPerceptronClassifier(
        layers=LAYERS, solver="gd", blockSize=16, maxIter=steps, stepSize=0.4, tol=0,
        initialWeights=Vectors.dense(w),
    ).fit(df.select(array_to_vector("features").alias("features"), F.col("label").cast("double")))
    ours = training.fit_mlp(
        df, LAYERS, settings=training.SgdSettings(step=0.4, iterations=steps), stack_size=16,
        initial_weights=w,
    )
    assert np.allclose(ours.weights, stock.weights.toArray(), atol=1e-12)


def test_relational_pass_shuffles_samples_once(spark):
    """Sums, windows and joins by sample reuse the partitioning of the samples."""
    x, y = data()
    layers = [5, 4, 6, 3]
    samples = table(spark, x, y)
    weights = network.weights_table(spark, weights_of(layers), layers)
    chain = network.forward(network.feature_entries(samples, "id"), weights, layers)
    targets = samples.select(F.col("id").alias("i"), "label", F.lit(1.0).alias("share"))
    deltas = network.backward(chain, targets, weights, layers).deltas

    def keys(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        found = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        return {tuple(re.sub(r"#.*", "", k) for k in each.split(", ")[:-1]) for each in found}

    # The samples and, where it is not broadcast, the targets; never (sample, unit).
    assert keys(chain[-1]) == {("i",)}
    assert keys(deltas[1]) == {("i",)}
