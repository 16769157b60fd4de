import random

import pytest
from pyspark.sql import functions as F

from blockweave.llm import decontam
from blockweave.llm.words import text_words
from tests.conftest import DATA

WORDS = [f"w{n}" for n in range(400)]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def brute(text, item):
    """Longest overlap along any diagonal: ends equal, long enough, enough equal."""
    a, b = text_words(text), text_words(item)
    need, best = min(decontam.MIN_OVERLAP, len(b)), 0
    for d in range(-len(b), len(a)):
        equal = [0 <= k + d < len(a) and a[k + d] == b[k] for k in range(len(b))]
        for i in range(len(b)):
            for j in range(i + need - 1, len(b)):
                if equal[i] and equal[j] and sum(equal[i : j + 1]) >= decontam.SIMILARITY * (j - i + 1) - 1e-9:
                    best = max(best, j - i + 1)
    return best if len(b) else 0


def test_overlaps_equal_brute_force_up_to_missed_seeds(spark):
    rng = random.Random(5)
    items = [(n, prose(rng, rng.randint(8, 40))) for n in range(12)]
    docs = []
    for n in range(60):
        words = text_words(items[n % 12][1])
        for k in rng.sample(range(len(words)), int(len(words) * (n % 5) * 0.05)):
            words[k] = "changed"
        docs.append((n, f"{prose(rng, 30)} {' '.join(words).upper()}, {prose(rng, 20)}" if n % 3 else prose(rng, 60)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {}
    for r in decontam.find_overlaps(table, bench).collect():
        key = r["doc_id"], r["item_id"]
        got[key] = max(got.get(key, 0), r["length"])
    want = {(d, i): brute(t, b) for d, t in docs for i, b in items}
    want = {k: v for k, v in want.items() if v}
    assert got == want


def test_blocks_give_the_same_result_as_one(spark):
    rng = random.Random(6)
    items = [(n, prose(rng, 20)) for n in range(30)]
    docs = [(n, items[n][1]) for n in range(0, 30, 2)] + [(100, prose(rng, 50))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    whole = sorted(tuple(r) for r in decontam.find_overlaps(table, bench).collect())
    assert whole == sorted(tuple(r) for r in decontam.find_overlaps(table, bench, block_bytes=2000).collect())
    assert [r["doc_id"] for r in decontam.drop_contaminated(table, bench, block_bytes=2000).collect()] == [100]


def test_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (None, "...")], "item_id bigint, text string")
    rows = [(1, "Zero ONE, two three four five six seven eight"), (2, None), (3, ""), (None, "one two three four five six seven"), (4, "word " * 50_000), (1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).withColumn("item", F.lit(0))
    got = sorted((r["doc_id"] or -1, r["item_id"], r["length"]) for r in decontam.find_overlaps(docs, bench).collect())
    assert got == [(-1, 1, 7), (1, 1, 7)]
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"] and r["text"][:4]) for r in kept.collect()) == [(1, "x"), (2, None), (3, ""), (4, "word")]
    assert decontam.find_overlaps(docs, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 6
    assert decontam.find_overlaps(docs.limit(0), bench).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_table_has_all_whole_passages(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], " ".join(text_words(r["text"]))) for r in bench.collect()]
    want = {(d["doc_id"], i) for d in docs.collect() for i, t in items if f" {t} " in f" {' '.join(text_words(d['text']))} "}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_overlaps(docs, bench).collect()}
    assert want <= got


def test_short_items_are_all_found(spark):
    rng = random.Random(11)
    items = [(n, " ".join(f"i{n}_{k}" for k in range(n))) for n in range(1, 13)] + [(20, "same same same same same same same")]
    docs = [(0, prose(rng, 40)), (1, " ".join(t for _, t in items))]
    for n, text in items:
        words = text_words(text)
        for k in range(len(words)):
            for j in range(k, len(words)):
                changed = [w if m not in (k, j) else "changed" for m, w in enumerate(words)]
                docs.append((len(docs), f"{prose(rng, 5)} {' '.join(changed)} {prose(rng, 5)}"))
    got = {}
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for r in decontam.find_overlaps(table, spark.createDataFrame(items, "item_id bigint, text string")).collect():
        got[r["doc_id"], r["item_id"]] = max(got.get((r["doc_id"], r["item_id"]), 0), r["length"])
    want = {(d, i): brute(t, b) for d, t in docs for i, b in items}
    assert got == {k: v for k, v in want.items() if v}
    assert {(1, i) for i, _ in items} <= set(got) and not any(d == 0 for d, _ in got)
