import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockweave.llm import token_orc
from tests.conftest import DATA

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = token_orc.tokenizer_path()
ODD = list("aAbZéÉßΣςσİıKſ '.,  \n\t!#$<>|́ 　漢가٣²½Ⅷ_-😀\x00\x1f\x85ﬁǅ") + ["'s", "'re", "don't", "<|endoftext|>"]


def plain_ids(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    return [e.ids + [token_orc.END_ID] for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(texts):
    ids, sizes = token_orc.Words.of(PATH).encode(pa.array(texts, pa.string()), token_orc.END_ID)
    want = plain_ids(texts)
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.lists(st.sampled_from(ODD), max_size=25).map("".join)), min_size=1, max_size=5))
def test_words_give_the_ids_of_the_whole_text(texts):
    check(texts)


def test_long_text():
    check(["word, other. " * 30_000, "x" * 50_000, None, ""])


def digest(rows):
    """Expected rows in ascending id order."""
    start, out = 0, []
    for i, ids in zip([i for i, _ in rows], plain_ids([t for _, t in rows]), strict=True):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, tmp_path):
    rows = [(n * 7 % 50, f"text number {n}, as it is. " * (n % 4)) for n in range(50)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("part", F.lit("clash"))
    path = token_orc.write_tokens(docs, str(tmp_path / "t"))
    got = sorted(tuple(r) for r in token_orc.token_digest(spark, path).collect())
    assert got == digest(sorted(rows))
    found = token_orc.lookup(spark, path, [7, 99]).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {i: ids for i, ids in zip((7, 99), plain_ids([dict(rows)[7], None]), strict=True)}


def test_repeated_and_null_ids_and_empty_tables(spark):
    rows = [(1, "b"), (1, "b"), (None, "a c"), (1, "a"), (0, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in token_orc.token_digest(spark, token_orc.write_tokens(docs)).orderBy("start").collect()]
    assert [g[0] for g in got] == [None, 0, 1, 1, 1]
    ends = [g[1] + g[2] for g in got]
    assert [0, *ends[:-1]] == [g[1] for g in got]
    assert token_orc.token_digest(spark, token_orc.write_tokens(docs.limit(0))).count() == 0


def test_files_have_bloom_filters_and_run_lengths(spark, tmp_path):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the same words again and again").alias("text"))
    path = token_orc.write_tokens(docs, str(tmp_path / "t"))
    orc = pytest.importorskip("pyarrow.orc")
    files = sorted((tmp_path / "t").glob("*.orc"))
    assert sum(orc.ORCFile(str(f)).nrows for f in files) == 5000
    assert sum(f.stat().st_size for f in files) < 5000 * 8  # equal lists run-length encode
    plan = token_orc.lookup(spark, path, [3])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "doc_id" in plan.split("PushedFilters: [")[1]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = sorted(tuple(r) for r in token_orc.token_digest(spark, token_orc.write_tokens(docs)).collect())
    assert got == digest(rows)
