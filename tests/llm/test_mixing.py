from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from blockweave.llm import mixing


@pytest.mark.parametrize("weights", [[1, 1], [5, 3, 2], [0.97, 0.01, 0.01, 0.01], list(range(1, 20))])
def test_frame_is_less_than_one_block_off(weights):
    frame = 128
    counts = mixing.whole_weights(weights, frame)
    assert sum(counts) == frame and min(counts) >= 1
    slots = mixing.frame_schedule(counts, frame)
    assert sorted(slots) == [(s, j) for s, n in enumerate(counts) for j in range(n)]
    done = [0] * len(counts)
    for t, (s, j) in enumerate(slots, 1):
        assert j == done[s]
        done[s] += 1
        assert j * frame // counts[s] < t <= -(-(j + 1) * frame // counts[s])
        for n, d in zip(counts, done, strict=True):
            assert abs(Fraction(n * t, frame) - d) < 1


def test_weights_must_be_positive():
    with pytest.raises(ValueError):
        mixing.whole_weights([1, 0], 8)


def test_phases_take_every_block_once():
    blocks = [100, 7, 0, 33]
    plan = mixing.phases(blocks, [1, 1, 1, 2], 16)
    for s, n in enumerate(blocks):
        taken = 0
        for p in plan:
            if s in p["sources"]:
                k = p["sources"].index(s)
                assert p["first"][k] == taken
                taken += min(n - taken, p["counts"][k] * p["frames"])
        assert taken == n


def documents(spark, sizes):
    rows, n = [], 0
    for source, count, length in sizes:
        for _ in range(count):
            rows.append((n, f"{n:04d}" + "x" * (length - 4), source))
            n += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)


def test_mixture_follows_weights(spark):
    docs = documents(spark, [("a", 300, 100), ("b", 100, 100), (None, 100, 100)])
    weights = {"a": 2.0, "b": 1.0, None: 1.0}
    rows = mixing.schedule(docs, weights, block_bytes=1000, frame=16).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(500))
    blocks = {}
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"]
        blocks.setdefault((r["slot"]), set()).add((r["source"], r["block"]))
    assert all(len(b) == 1 for b in blocks.values())
    order = [next(iter(blocks[s]))[0] for s in sorted(blocks)]
    done = {k: 0 for k in weights}
    for t, source in enumerate(order[:40], 1):  # all sources last so long
        done[source] += 1
        assert all(abs(w / 4 * t - done[k]) < 1 for k, w in weights.items())


def test_mix_keeps_rows_columns_and_order(spark, tmp_path):
    docs = documents(spark, [("a", 60, 50), ("b", 20, 50)])
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, "a"), (None, "", None)], docs.schema))
    docs = docs.withColumn("slot", F.lit(1)).withColumn("mix_at", F.lit(2))
    mixing.mix(docs, block_bytes=200).write.parquet(str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m"))
    assert got.columns == docs.columns and got.count() == 85
    assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect()))
    read = [r["source"] for r in got.select("source", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
    assert read != sorted(read, key=lambda s: s or "")


def test_empty_table_and_missing_weight(spark):
    docs = documents(spark, [("a", 3, 10), ("b", 1, 10)])
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"a": 1.0})


@pytest.mark.parametrize("weights", [[0.9999, 0.0001], [(n + 1) ** 0.5 for n in range(20)], [0.7, 0.2137, 0.0863]])
def test_many_frames_stay_less_than_one_block_off_the_given_weights(weights):
    frame, frames = 128, 120
    plan = mixing.phases([frame * frames] * len(weights), weights, frame)[:frames]
    done, total = [0] * len(weights), sum(map(Fraction, weights))
    for n, p in enumerate(plan):
        assert p["start"] == n * frame and p["first"] == done and len(p["sources"]) == len(weights)
        for t, (s, j) in enumerate(mixing.frame_schedule(p["weights"], frame, p["done"], p["start"] - p["origin"]), p["start"] + 1):
            assert j == done[s]
            done[s] += 1
            assert all(abs(Fraction(w) / total * t - d) < 1 for w, d in zip(weights, done, strict=True))


def test_documents_follow_weights_that_do_not_divide_a_frame(spark):
    docs = documents(spark, [("a", 600, 100), ("b", 120, 100), ("c", 60, 100)])
    weights = {"a": 0.83, "b": 0.1237, "c": 0.0463}
    rows = mixing.schedule(docs, weights, block_bytes=100, frame=16).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(780)) and len({r["slot"] for r in rows}) == 780
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    done = dict.fromkeys(weights, 0)
    for t, r in enumerate(sorted(rows, key=lambda r: r["slot"])[:700], 1):
        done[r["source"]] += 1
        assert all(abs(w * t - done[k]) < 1 + 1e-9 for k, w in weights.items())


def test_copies_of_a_row_follow_the_schedule(spark, tmp_path):
    copies = spark.range(500).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("c" * 100).alias("text"), F.lit("a").alias("source"))
    others = spark.range(500).select((F.col("id") + 10).alias("doc_id"), F.lit("o" * 100).alias("text"), F.lit("b").alias("source"))
    same = others.select("doc_id", "text", F.lit("a").alias("source")).where("doc_id < 15")  # equal but for the source
    docs = copies.unionByName(others).unionByName(same).repartition(4)
    placed = mixing.schedule(docs, {"a": 1.0, "b": 1.0}, block_bytes=1000)
    most = placed.where("doc_id = 1").groupBy("slot").count().agg(F.max("count")).first()[0]
    assert most <= 11 and placed.count() == 1005
    mixing.mix(docs, {"a": 1.0, "b": 1.0}, block_bytes=1000).write.parquet(str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m"))
    read = [r["source"] for r in got.select("source", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
    ahead = 0
    for source in read[:980]:
        ahead += 1 if source == "a" else -1
        assert abs(ahead) <= 24  # two blocks of ten rows, and a part of one


def test_no_bucket_holds_all_copies(spark):
    docs = spark.range(8000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("same").alias("text"), F.lit("a").alias("source"))
    keys = mixing.in_blocks(docs.repartition(4), 100, 7, "doc_id", "text", "source")
    assert keys.agg(F.countDistinct("key")).first()[0] == 8000
