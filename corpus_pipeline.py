"""A corpus from documents to token files: quality, near-duplicates, decontamination, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``. The
mixture's decision is the order of the written files; the last stage writes token files in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm import decontam, mixing, ordinal, probminhash, token_orc
from blockweave.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is likely; toxic and poor ones go."""
    model = ordinal.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal.select_good(docs, model).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id."""
    return probminhash.keep_one(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files whose order interleaves the sources by their weights."""
    return mixing.mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixture; where each document lies in them."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    placed = docs.select("doc_id", "text", number.alias("file"), F.col("_metadata.row_index").alias("row"))
    order = [F.col("file").cast("int"), F.col("row")]
    return token_orc.token_digest(spark, token_orc.write_tokens(placed, order=order))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: No stage but the row counts can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
