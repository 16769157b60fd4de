import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blockweave.llm import probminhash as pm
from blockweave.llm.words import text_words
from tests.conftest import DATA

WORDS = [f"w{n}" for n in range(5000)]


def shingle_weights(text):
    w = text_words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[k : k + pm.WIDTH]) for k in range(max(1, len(w) - pm.WIDTH + 1)))


def brute_similarity(a, b):
    x, y = shingle_weights(a), shingle_weights(b)
    if not x or not y:
        return float(a == b)
    plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    weighted = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
    return max(plain, weighted)


def arrays(text):
    _, elements, weights = pm.weighted(*pm.shingles(*pm.hashed([text], pm.WordHashes()), pm.WIDTH))
    return elements, weights


def edited(rng, text, changes):
    words = text.split()
    for k in rng.sample(range(len(words)), changes):
        words[k] = rng.choice(WORDS)
    return " ".join(words)


def test_similarity_equals_definition():
    rng = random.Random(1)
    base = " ".join(rng.choices(WORDS[:30], k=120))
    for text in (base, edited(rng, base, 3), base + " " + base, base[:200] + " " + base, "a b", ""):
        got = pm.similarity(arrays(base), arrays(text))
        assert got == pytest.approx(brute_similarity(base, text)) or got >= pm.SIMILARITY <= brute_similarity(base, text)


def test_registers_agree_as_often_as_probability_jaccard():
    rng = np.random.default_rng(3)
    elements = rng.integers(1, 2**63, 60).astype(np.uint64)
    w1, w2 = rng.integers(1, 6, 60).astype(float), rng.integers(1, 6, 60).astype(float)
    of = np.repeat([0, 1], 50)
    chosen = [np.arange(50), np.arange(10, 60)]
    registers = 1 << 14
    z = pm.signatures(of, elements[np.concatenate(chosen)], np.concatenate([w1[chosen[0]], w2[chosen[1]]]), 2, registers)
    x, y = dict(zip(chosen[0], w1[chosen[0]], strict=True)), dict(zip(chosen[1], w2[chosen[1]], strict=True))
    want = sum(
        1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys()
    )
    assert abs((z[0] == z[1]).mean() - want) < 5 * (want * (1 - want) / registers) ** 0.5


def test_signature_does_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(WORDS, k=k)) for k in (1, 3, 6, 40, 400)]

    def signed(some):
        of, elements, weights = pm.weighted(*pm.shingles(*pm.hashed(some, pm.WordHashes()), pm.WIDTH))
        return pm.signatures(of, elements, weights, len(some))

    together = signed(texts)
    for k, text in enumerate(texts):
        assert (signed([text])[0] == together[k]).all()


def brute_classes(rows):
    """Connected components over all pairs."""
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if brute_similarity(a or "", b or "") >= pm.SIMILARITY:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in rows}


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for n in range(12):
        base = " ".join(rng.choices(WORDS, k=rng.randint(30, 200)))
        rows += [(len(rows) + k, t) for k, t in enumerate([base, base.upper() + "!", edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, 15)][: 1 + n % 5])]
    chain = " ".join(rng.choices(WORDS, k=120))  # neighbours are similar, the ends are not
    for _ in range(6):
        rows.append((len(rows), chain))
        words = chain.split()
        at = rng.randrange(0, 110)
        chain = " ".join(words[:at] + rng.choices(WORDS, k=5) + words[at + 5 :])
    rows += [(500, None), (501, ""), (502, "..."), (503, "one two"), (504, "One, two"), (505, "two one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).withColumn("cls", F.lit(1)).withColumn("rep", F.lit("x"))
    got = {r["doc_id"]: r["class_id"] for r in pm.near_duplicates(docs).collect()}
    want = brute_classes(rows)
    want |= {500: 500, 501: 500, 502: 502, 503: 503, 504: 503, 505: 505}
    assert got == want
    kept = pm.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_hot_class_and_repeated_rows(spark):
    rng = random.Random(5)
    base = " ".join(rng.choices(WORDS, k=300))
    rows = [(n, base if n % 3 else edited(rng, base, n % 7)) for n in range(400)] + [(5, base)] * 3 + [(None, base), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = pm.near_duplicates(docs).collect()
    assert len(got) == 403 and {r["class_id"] for r in got} == {0}
    kept = pm.keep_one(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 0), (True, 0), (True, 0)]
    assert pm.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    rng = random.Random(7)
    names = rng.sample(range(1000), 80)
    edges = [(names[k], names[k + 1]) for k in range(79) if k != 40]
    links = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in pm.components(links).collect()}
    assert got == {x: min(part) for part in (names[:41], names[41:]) for x in part}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r["class_id"] for r in pm.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def with_passages(rng, repeats):
    """Texts with the same shingles, one passage of which is repeated differently often: plain 1, weighted less."""
    words = rng.sample(WORDS, 214)
    return [" ".join(words[:204] + words[204:] * n) for n in repeats]


def test_plain_jaccard_links_are_found_whatever_the_weights(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(8):
        texts = with_passages(rng, (10, 100, 1000))
        texts.append(edited(rng, with_passages(rng, (2,))[0], 1))
        rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in pm.near_duplicates(docs).collect()}
    assert got == {n: n if n % 4 == 3 else n - n % 4 for n in got} and len(got) == len(rows)


@pytest.mark.parametrize("kinds", [(10, 100), (2, 60)])
def test_block_comparison_passes_pairs_that_are_near_in_either_signature(kinds):
    texts = with_passages(random.Random(9), kinds)
    hashes = pm.WordHashes()
    long, short = pm._signed(texts, hashes, pm.LONG_REGISTERS), pm._signed(texts, hashes, pm.REGISTERS)
    z = np.frombuffer(b"".join(long[0].to_pylist()), "<u2").reshape(2, -1)
    assert (z[0] == z[1]).mean() < pm.NEAR
    rows = pd.DataFrame({
        "bucket": 1, "band": 0, "rep": [4, 3], "component": [4, 3], "block": 0, "i": 0, "j": 0,
        "signature": long[0].to_pylist(), "plain": long[1].to_pylist(),
        "bands": short[0].to_pylist(), "plain_bands": short[1].to_pylist(),
    })
    assert pm._across(rows).values.tolist() == [[3, 4]]
    # met in band 0 by their plain signatures
    assert pm._across(rows.assign(band=1)).empty
