import hashlib
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    whole = [(i, [math.floor(scale * x) for x in v] + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    cut = [[v[p * width : (p + 1) * width] for _, v, _ in whole] for p in range(parts)]
    order = sorted(range(len(whole)), key=lambda n: (whole[n][0] is None, whole[n][0] or 0, struct.pack(f"<{width * parts}d", *whole[n][1])))
    books = [[list(cut[p][n]) for n in order[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut[p]:
                groups.setdefault(near(v, books[p])[1], []).append(v)
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    met = [[near(v, books[p]) for v in cut[p]] for p in range(parts)]
    errors = [sum(met[p][n][0] for p in range(parts)) for n in range(len(whole))]
    codes = ["".join(f"{met[p][n][1]:02x}" for p in range(parts)) for n in range(len(whole))]
    sums = {}
    for (_, _, label), e in zip(whole, errors, strict=True):
        sums[label] = sums.get(label, 0) + min(e, 2**63 - 1)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for n, (i, _, label) in enumerate(whole):
        out.append((i, codes[n], min(errors[n], 2**63 - 1), min(sums[label], 2**63 - 1), digest))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(
        {"code": F.lit("clash"), "error": F.lit(1), "v": F.lit(2), "of": F.lit(3), "x": F.lit(None)}
    )
    return sorted((tuple(r) for r in vector_codes.vector_codes(df, **options).collect()), key=repr)


def drawn(seed, n, dims, spread):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dims)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("n,dims,spread", [(400, 8, 1.0), (300, 16, 0.01), (300, 4, 1e7), (280, 8, 1e30)])
def test_equals_brute_force(spark, n, dims, spread):
    rows = drawn(n, n, dims, spread)
    assert found(spark, rows, entries=32) == brute(rows, entries=32)


def test_production_size(spark):
    rows = drawn(3, 350, 64, 0.2)
    assert found(spark, rows) == brute(rows)


def test_nulls_ties_repeats_lengths(spark):
    rows = [(n % 40, [float(n % 3), 0.5, -0.25, 1.0], n % 2) for n in range(120)]
    rows += [(500, None, 1), (501, [None, 1.0, 1.0, 1.0], 1), (502, [math.nan] * 4, None), (503, [math.inf, 0.0, 0.0, 0.0], 1)]
    rows += [(None, [0.1, 0.2, 0.3, 0.4], None), (None, [0.1, 0.2, 0.3, 0.4], None), (504, [], 7), (505, [1.0] * 6, None)]
    rows += [(506, [-0.0, 1e-320, -1e-320, 0.0], 2)]
    assert found(spark, rows, entries=16) == brute(rows, entries=16)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:3], rounds=0) == brute(rows[:3], rounds=0)
    assert found(spark, [(1, [], 1)]) == brute([(1, [], 1)])


def test_one_large_value_among_small_ones(spark):
    rows = drawn(8, 200, 8, 1.0)
    rows[5] = (5, [1e30, -3e25, 1.0, 0.0, 1e200, 2.0, -7.5, 1e-9], 1)
    rows[150] = (150, [1e16 + 2, 1.0, -1e16, 0.0, 1.0, 1.0, 1.0, 1.0], None)
    assert found(spark, rows, entries=32) == brute(rows, entries=32)


def test_empty_and_settings(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1)]) == []
    for wrong in ({"parts": 0}, {"entries": 0}, {"entries": 1 << 17}, {"rounds": -1}):
        with pytest.raises(ValueError):
            found(spark, [(1, [1.0], 1)], **wrong)


@pytest.mark.parametrize("bits", [3, 8, 20])
def test_limbs_give_exact_products(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(-(2**40), 2**40, (30, 5))
    y = rng.integers(-(2**40), 2**40, (7, 5))
    for left in (x.astype(np.float64), x.astype(object)):
        parts = vector_codes.limbs(left, bits, vector_codes.limb_count(2**40, bits))
        back = sum(p.astype(object) * (1 << bits * k) for k, p in enumerate(parts))
        assert (back == x).all() and all(np.abs(p).max() < 2**bits for p in parts)
    right = vector_codes.limbs(y.astype(object), bits, vector_codes.limb_count(2**40, bits))
    exact = x.astype(object) @ y.astype(object).T
    assert (vector_codes.dot_products(parts, right, bits, True) == exact).all()


def test_nearest_takes_few_bits_to_the_same_result():
    rng = np.random.default_rng(4)
    rows, book = rng.integers(-600, 600, (500, 16)).astype(float), rng.integers(-600, 600, (64, 16))
    shape = vector_codes.Shape(16, 500, 600)
    one, error = vector_codes.nearest(rows, book, shape)
    many, other = vector_codes.nearest(rows, book, shape, bits=4)
    apart = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (one == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()
    assert (one == many).all() and (error == other).all()
