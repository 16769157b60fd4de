import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.llm import ordinal
from blockweave.llm.words import WordHashes

GOOD, BAD, JUNK = [f"g{n}" for n in range(300)], ["foul", "vile"], ["###", "!!!"]


def rated(rng, n):
    out = []
    for k in range(n):
        words = rng.choices(GOOD, k=rng.randint(5, 60))
        kind = k % 3
        if kind == 0:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        elif kind == 1:
            words = [w + rng.choice(JUNK) for w in words]
        out.append((k, " ".join(words), int(kind != 1), int(kind == 0)))
    return out


def test_gradient_is_the_derivative():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 5, 2])
    flat = rng.integers(0, 16, sizes.sum())
    grades = np.array([0, 1, 2, 2])
    x = np.concatenate([rng.normal(0, 1, 16), [-0.5, 0.3]])
    loss, gradient = ordinal.loss_and_gradient(x, flat, sizes, grades)
    for k in range(len(x)):
        step = np.zeros(len(x))
        step[k] = 1e-6
        up, down = (ordinal.loss_and_gradient(x + s * step, flat, sizes, grades)[0] for s in (1, -1))
        assert gradient[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    assert loss == pytest.approx(
        -sum(np.log(p) for p in grade_probabilities(x, flat, sizes, grades)), rel=1e-9
    )


def grade_probabilities(x, flat, sizes, grades):
    limits = ordinal.thresholds(x[-2:])
    at = 0
    for size, g in zip(sizes, grades, strict=True):
        score = x[:-2][flat[at : at + size]].sum()
        at += size
        cdf = [0.0, *(1 / (1 + np.exp(-(t - score))) for t in limits), 1.0]
        yield cdf[g + 1] - cdf[g]


def test_minimise_finds_the_least_of_a_quadratic():
    a = np.diag([1.0, 10.0, 100.0])
    target = np.array([1.0, -2.0, 3.0])
    x = ordinal.minimise(np.zeros(3), lambda v: (0.5 * (v - target) @ a @ (v - target), a @ (v - target)), 100)
    assert np.allclose(x, target, atol=1e-2)


def test_features_count_once_and_handle_odd_texts():
    flat, sizes = ordinal.features([None, "", "a a A b !!", "퟿ x"], WordHashes())
    assert sizes[0] == sizes[1] > 0 and sizes.sum() == len(flat)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(3)
    rows = rated(rng, 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(4)
    docs = docs.withColumn("grade", F.lit("clash")).withColumn("toxic", F.lit(7))
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows if i < 600] + [(None, 1, 0), (10**6, 1, 0), (0, None, 1)], "doc_id bigint, quality int, toxic int")
    model = ordinal.fit(docs, labels)
    assert (np.diff(model.limits) > 0).all()
    got = {r["doc_id"]: r for r in ordinal.grade(docs, model).collect()}
    assert len(got) == 900
    held = [r for r in rows if r[0] >= 600]
    right = sum(got[i]["keep"] == (q == 1 and not t) for i, _, q, t in held)
    assert right / len(held) > 0.97
    mean = {k: np.mean([got[i]["expected_grade"] for i, *_ in held if i % 3 == k]) for k in range(3)}
    assert mean[0] < mean[2] and mean[1] < mean[2]
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "g1 " * 50_000)], "doc_id bigint, text string")
    assert ordinal.grade(odd, model).count() == 4
    kept = ordinal.select_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in got.values())
    assert ordinal.grade(docs.limit(0), model).count() == 0


def test_sample_is_bounded_and_no_labels_keep_all(spark):
    rng = random.Random(4)
    rows = rated(rng, 90)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id bigint, quality int, toxic int")
    assert ordinal.training_rows(docs, labels, 40).count() == 40
    model = ordinal.fit(docs, labels.limit(0))
    assert {r["keep"] for r in ordinal.grade(docs, model).collect()} == {True}


def brute_fit(x, grades, penalty, rounds=60):
    """Newton's method on the penalised likelihood of dense features, derivatives by complex steps and differences."""

    def loss(params):
        cut = params[-2] + np.array([0, np.exp(params[-1])])
        score = x @ params[:-2]
        at_most = [1 / (1 + np.exp(score - c)) for c in cut]
        p = np.choose(grades, [at_most[0], at_most[1] - at_most[0], 1 - at_most[1]])
        return -np.log(p).sum() + 0.5 * penalty * (params[:-2] ** 2).sum()

    def slope(params):
        steps = 1e-20j * np.eye(len(params))
        return np.array([loss(params + s).imag for s in steps]) / 1e-20

    params = np.zeros(x.shape[1] + 2)
    for _ in range(rounds):
        g = slope(params)
        if np.abs(g).max() < 1e-8:
            break
        bend = np.array([slope(params + s) - slope(params - s) for s in 1e-5 * np.eye(len(params))]) / 2e-5
        values, axes = np.linalg.eigh((bend + bend.T) / 2)
        move = -axes @ ((axes.T @ g) / np.maximum(np.abs(values), 1e-3))
        step = 1.0
        while loss(params + step * move) > loss(params) and step > 1e-9:
            step /= 2
        params = params + step * move
    return params, loss


def test_fit_is_that_of_newtons_method_on_dense_features(spark):
    rng = random.Random(8)
    words = {0: ["foul", "vile", "red", "blue"], 1: ["meh", "red", "blue", "green"], 2: ["fine", "neat", "blue", "green"]}
    rows = []
    for k in range(120):
        grade = rng.choice([0, 1, 2])
        source = words[grade if rng.random() < 0.8 else rng.choice([0, 1, 2])]
        rows.append((k, " ".join(rng.choices(source, k=rng.randint(1, 5))), grade))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(g == 2), int(g == 0)) for k, _, g in rows], "doc_id bigint, quality int, toxic int")
    flat, sizes = ordinal.features([t for _, t, _ in rows], WordHashes())
    dense = np.zeros((len(rows), ordinal.FEATURES), bool)
    dense[np.repeat(np.arange(len(rows)), sizes), flat] = True
    kept = np.flatnonzero(dense.sum(axis=0) >= 2)
    x, grades = dense[:, kept].astype(float), np.array([g for *_, g in rows])
    best, loss = brute_fit(x, grades, ordinal.PENALTY)
    model = ordinal.fit(docs, labels)
    gap = np.log(np.diff(model.limits))
    found = np.concatenate([model.weights[kept].astype(float), model.limits[:1], gap])
    assert loss(found) <= loss(best) + 1e-3 * abs(loss(best))
    assert set(np.flatnonzero(model.weights)) <= set(kept)
    p_top = 1 / (1 + np.exp(best[-2] + np.exp(best[-1]) - x @ best[:-2]))
    got = {r["doc_id"]: r for r in ordinal.grade(docs, model).collect()}
    assert np.allclose([got[k]["p_top"] for k in range(120)], p_top, atol=0.03)
    clear = np.abs(p_top - ordinal.KEEP) > 0.03
    assert clear.mean() > 0.8
    assert all(got[k]["keep"] == (p_top[k] >= ordinal.KEEP) for k in np.flatnonzero(clear))
