import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, add=0):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + add, text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """(top, siblings of each node level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            if p ^ 1 < len(nodes):
                paths[k].append((p & 1, nodes[p ^ 1]))
            else:
                paths[k].append((0, ""))
            at[k] = p >> 1
        nodes = [h("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    out, tops = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        top, paths = climb([leaf_of(r) for r in mine])
        tops.append((top, mine, paths))
    if not tops:
        return []
    root, upper = climb([t for t, _, _ in tops])
    for (top, mine, paths), above in zip(tops, upper, strict=True):
        for row, path in zip(mine, paths, strict=True):
            changed = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf_of(row, int(changed))
            for left, beside in path + above:
                node = h(beside + node if left else node + beside)
            out.append((row[0], leaf_of(row), top, root, h("".join(b for _, b in path + above)), node, node == root))
    return sorted(out, key=repr)


def found(spark, rows, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns(
        {"grp": F.lit("clash"), "leaf": F.lit(1), "pos": F.lit(2), "n": F.lit(3), "path": F.lit("x"), "bucket": F.lit(4)}
    )
    leaves = merkle.document_leaves(df, merkle.every_seventh(F.col("doc_id")))
    return sorted((tuple(r) for r in merkle.manifest(leaves).collect()), key=repr)


def drawn(seed, ids):
    rng = random.Random(seed)
    return [(i, f"tëxt {rng.random()}", rng.choice(["en", "en", "de", "", None]), rng.choice(["a", None]), rng.randint(0, 9)) for i in ids]


def test_dense_ids(spark):
    rows = drawn(1, range(700))
    got = found(spark, rows)
    assert got == brute(rows)
    assert 0 < sum(not r[-1] for r in got) < 200


@pytest.mark.parametrize("seed", [2, 3])
def test_sparse_negative_and_far_ids(spark, seed):
    rng = random.Random(seed)
    ids = {rng.randint(-(2**63), 2**63 - 1) for _ in range(200)} | set(range(-40, 40)) | {2**63 - 1, -(2**63)}
    rows = drawn(seed, ids)
    assert found(spark, rows) == brute(rows)


def test_nulls_and_repeated_ids(spark):
    rng = random.Random(5)
    rows = drawn(5, [rng.choice([None, 3, 3, 70_000, 70_001, rng.randint(0, 300)]) for _ in range(300)])
    rows += [(7, None, None, None, None), (8, "", "", "", 2**63 - 1), (0, "x", "en", "s", 2**63 - 1)] + [(9, "same", "en", "s", 4)] * 40
    rows += [(None, "same", "en", "s", 4)] * 9
    assert found(spark, rows) == brute(rows)


def test_small_and_empty_tables(spark):
    one = (5, "a", "en", "s", 1)
    assert found(spark, []) == []
    for rows in ([one], [one, (6, "b", "fr", "s", 1)], [one] * 3, [(None, None, None, None, None)]):
        assert found(spark, rows) == brute(rows)


def test_several_rounds_of_slot_arrays(spark, monkeypatch):
    # 9,000 leaves of one group take two rounds
    rows = [(n, str(n), "en" if n % 10 else "de", "s", n) for n in range(10_000)]
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    assert found(spark, rows) == brute(rows)


def test_containers_ranks_and_directories(spark):
    rng = np.random.default_rng(1)
    for lows in (np.arange(100, 60_000), np.sort(rng.choice(65_536, 50, replace=False)), np.sort(rng.choice(65_536, 30_000, replace=False)), np.array([65_535])):
        words = merkle.container_words(merkle.to_container(lows))
        assert (np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")) == lows).all()
        asked = rng.integers(0, 65_536, 500)
        assert (merkle.ranks(words, asked) == np.searchsorted(lows, asked)).all()
        assert len(merkle.to_container(lows)) <= 8193
    buckets = sorted({int(b) for b in rng.integers(-(2**47), 2**47, 300)} | set(range(2000)))
    counts = spark.createDataFrame([("1a", b, k % 5 + 1) for k, b in enumerate(buckets)], "grp string, bucket bigint, ids bigint")
    got = {r["bucket"]: (r["start"], r["n"]) for r in merkle.directory(counts).collect()}
    total = sum(k % 5 + 1 for k in range(len(buckets)))
    assert got == {b: (sum(j % 5 + 1 for j in range(k)), total) for k, b in enumerate(buckets)}
