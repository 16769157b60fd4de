import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from blockweave.llm import decontam, mixing, ordinal, probminhash  # noqa: E402
from tests.conftest import DATA  # noqa: E402
from tests.llm.test_probminhash import brute_classes  # noqa: E402
from tests.llm.test_token_orc import plain_ids  # noqa: E402


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mixture", "tokens"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_each_stage_against_plain_rules(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    inputs = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        inputs[name] = docs
        out = stage(spark, docs, str(DATA))
        assert out.columns == columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = {name: {r["doc_id"]: r for r in df.collect()} for name, df in [*inputs.items(), ("out", docs)]}
    # quality
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [i for i, (q, t) in labels.items() if q and not t and i in rows["quality"]]
    assert sum(i in rows["near_dedup"] for i in good) / len(good) > 0.95
    # near-duplicates
    classes = brute_classes(sorted((i, r["text"]) for i, r in rows["near_dedup"].items()))
    assert set(rows["decontaminate"]) == set(classes.values())
    # decontamination
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    dirty = {r["doc_id"] for r in decontam.find_overlaps(inputs["decontaminate"], bench).collect()}
    assert set(rows["mixture"]) == set(rows["decontaminate"]) - dirty
    # mixture: all rows, in the order of the schedule
    assert rows["out"] == rows["mixture"]
    slots = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.schedule(inputs["mixture"]).collect()}
    order = [r["doc_id"] for r in docs.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
    assert [slots[i] for i in order] == sorted(slots[i] for i in order)
    # tokens, in that order
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.tokens(spark, docs, str(DATA)).collect())
    ids = plain_ids([rows["out"][i]["text"] for i in order])
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert got == [(s, i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for s, i, x in zip(starts, order, ids, strict=True)]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, str(DATA))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
    assert ordinal.GRADES == 3 and probminhash.SIMILARITY == 0.8
