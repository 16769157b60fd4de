import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.llm import sharding


@pytest.mark.parametrize("good,bad,drawn", [(5, 7, 4), (50, 30, 40), (3, 0, 2), (0, 4, 3), (10**11, 7 * 10**11, 10**6)])
def test_hypergeometric_law(good, bad, drawn):
    rng = np.random.default_rng(1)
    x = np.array([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(4000)])
    assert x.min() >= max(0, drawn - bad) and x.max() <= min(good, drawn)
    n = good + bad
    mean = drawn * good / n
    var = drawn * good / n * (bad / n) * ((n - drawn) / max(1, n - 1))
    assert abs(x.mean() - mean) <= 5 * (var / len(x)) ** 0.5 + 1e-9
    assert var == 0 or abs(x.var() / var - 1) < 0.15


def test_small_law_is_exact():
    from math import comb

    rng = np.random.default_rng(2)
    x = np.bincount([sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20000)], minlength=5) / 20000
    p = np.array([comb(5, k) * comb(7, 4 - k) / comb(12, 4) for k in range(5)])
    assert np.abs(x - p).max() < 0.015


def test_matrix_has_both_margins():
    counts, sizes = [100, 0, 3, 57], sharding.shard_sizes(160, 8)
    matrix = np.array(sharding.communication_matrix(counts, sizes, 3))
    assert matrix.sum(1).tolist() == counts and matrix.sum(0).tolist() == sizes and matrix.min() >= 0
    with pytest.raises(ValueError):
        sharding.communication_matrix([1], [2], 0)


def shards(df, n=8):
    rows = df.collect()
    by = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(n)}
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(v == list(range(len(v))) for v in by.values())
    return rows


def test_shards_are_exact_and_rows_whole(spark):
    rows = [(n, "same text" if n % 3 else f"té {n}") for n in range(1003)] + [(None, None), (5, "same text"), (5, "same text"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).withColumn("shard", F.lit(99)).withColumn("slot", F.lit(9))
    got = shards(sharding.shuffle_into_shards(docs, bucket_rows=16))
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_uniform_over_shards_and_slots(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(5)
    rows = shards(sharding.shuffle_into_shards(docs))
    table = np.zeros((4, 8))
    places = np.zeros((4, 4))
    for r in rows:
        table[r["doc_id"] // 1000, r["shard"]] += 1
        places[r["doc_id"] // 1000, min(3, r["slot"] // 125)] += 1
    assert ((table - 125) ** 2 / 125).sum() < 60 and ((places - 250) ** 2 / 250).sum() < 40
    again = shards(sharding.shuffle_into_shards(docs, seed=1))
    moved = {r["doc_id"]: r["shard"] for r in again}
    assert 300 < sum(moved[r["doc_id"]] == r["shard"] for r in rows) < 700


def test_no_python_in_the_plan_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = sharding.shuffle_into_shards(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapInArrow"))
    assert sharding.shuffle_into_shards(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(docs, shards=0)


def test_copies_spread_over_all_shards(spark):
    rows = [(n % 4, f"value {n % 4}") for n in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = shards(sharding.shuffle_into_shards(docs, bucket_rows=64))
    table, halves = np.zeros((4, 8)), np.zeros((4, 2))
    for r in got:
        table[r["doc_id"], r["shard"]] += 1
        halves[r["doc_id"], r["slot"] // 250] += 1
    assert ((table - 125) ** 2 / 125).sum() < 60  # 21 degrees of freedom
    assert ((halves - 500) ** 2 / 500).sum() < 30
