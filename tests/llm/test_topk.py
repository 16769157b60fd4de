import math
import random

import pytest
from pyspark.sql import functions as F

from blockweave.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, step, k, scale=256):
    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v)

    vectors = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    queries = {}
    for i, v in vectors:
        if i % step == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v)]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(spark, rows, step=5, k=5, **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(3).withColumn("score", F.lit(1)).withColumn("v", F.lit("clash"))
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % step == 0, k, **options).collect())


def single(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("dims,spread", [(1, 1.0), (4, 0.01), (16, 1.0), (64, 0.2)])
def test_equals_brute_force(spark, dims, spread):
    rng = random.Random(dims)
    rows = [(n, [single(rng.gauss(0, spread)) for _ in range(dims)]) for n in range(700)]
    assert found(spark, rows) == brute(rows, 5, 5)


def test_ties_repeats_nulls_and_lengths(spark):
    rows = [(n, [1.0, float(n % 2)]) for n in range(60)] + [(10, [1.0, 5.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    rows += [(100, None), (105, []), (110, [None, 1.0]), (115, [float("nan"), 1.0]), (120, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    rows += [(200, [1.0, 2.0, 3.0]), (201, [1.0, 0.0, -1.0])]
    assert found(spark, rows) == brute(rows, 5, 5)
    assert found(spark, rows[:1]) == []
    assert found(spark, rows, block_bytes=64) == brute(rows, 5, 5)


def test_empty_table_and_k(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0]), (1, [2.0])], k=1) == [(0, 1, 1, 256 * 512)]
    with pytest.raises(ValueError):
        found(spark, [(0, [1.0])], k=0)


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(n, [single(rng.uniform(-1e6, 1e6)) for _ in range(3)]) for n in range(40)]
    assert found(spark, rows) == brute(rows, 5, 5)
    huge = [(0, [1e30]), (1, [1e30]), (2, [-1e30]), (3, [1.0])]
    assert found(spark, huge, k=3) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 2, -(2**63))]


def test_reading_stops_before_the_end_where_scores_differ(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 40, (4096, 8)))
    x[:5] += 400
    depths = []
    sort, where = np.sort, np.where
    monkeypatch.setattr(np, "where", lambda *a: (depths.append(1), where(*a))[1])
    result = topk.top_of_chunk(np.full((1, 8), 100.0), np.array([-1]), np.arange(4096), x, 5, np.array([-np.inf]))
    assert set(range(5)) <= set(result[0][0].tolist()) and len(depths) <= 4 and sort is np.sort


def searched(x, queries, k=5, floor=-math.inf):
    import numpy as np

    lists = topk.SortedLists(x)
    n = len(queries)
    found = topk.top_of_chunk(queries, np.full(n, -1), np.arange(len(x)), x, k, np.full(n, floor), lists)
    for q, (ids, scores) in zip(queries, found, strict=True):
        whole = x @ q
        best = [i for i in np.lexsort((np.arange(len(x)), -whole))[:k] if whole[i] >= floor]
        assert [i for i in ids[np.lexsort((ids, -scores))][:k] if whole[i] >= floor] == best
        assert (scores == whole[ids]).all()
    return lists.read / (x.size * n)


def test_entries_are_read_once_and_only_as_deep_as_needed():
    import numpy as np

    rng = np.random.default_rng(3)
    skewed = np.floor(256 * rng.normal(0, 1, (4096, 4)) ** 3)
    positive = np.abs(skewed) * rng.integers(1, 50, (4096, 1))  # lists that agree on their best, far ends at zero
    assert searched(positive, np.abs(np.floor(rng.normal(0, 100, (20, 4))))) < 0.3
    assert searched(skewed, np.floor(rng.normal(0, 100, (20, 4)))) < 1
    assert searched(np.floor(rng.normal(0, 256, (4096, 64))), np.floor(rng.normal(0, 256, (8, 64)))) <= 1
    assert searched(np.zeros((300, 3)), np.ones((2, 3))) == 1
    assert searched(skewed, np.ones((3, 4)), floor=1e12) == 0
    assert searched(skewed[:, :1], np.array([[1.0], [-1.0], [0.0]])) < 0.5
