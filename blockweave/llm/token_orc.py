"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of their id, sorted inside a range, tokenized where they lie and written by
Spark's ORC writer: id lists are integer streams in ORC's run-length encoding, every stripe has row indexes
(least and largest id of each ``INDEX_ROWS`` rows) and a Bloom filter on ``doc_id``. Stripes are read in
parallel; ``lookup`` lets the reader skip stripes and row groups by that metadata.

``start``, the number of ids in all documents before, is the tokens before it in its file part (counted
while writing) plus the sum of the earlier parts, which has one row a part.

Words are tokenized once a task: a text is cut at white space, which the tokenizer drops and no token
spans, and each different word goes through the tokenizer's own BPE model. ``_ids`` says for which words
its steps are that simple; any other word goes through the whole tokenizer.

Defined results: a null text is empty and has the end id only. Documents with the same id are ordered by a
hash of their text, then text; equal ones are alike. Null ids come first. An empty table gives no rows.
``order`` may name other columns to write by (the pipeline keeps the mixed order). Only named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockweave.llm.common import release_memory, text_runs
from blockweave.session import scratch_path

TOKENIZER, END_ID = "word_bpe_49k.json", 2
STRIPE_BYTES, INDEX_ROWS = 64 * 1024 * 1024, 1_000
#: Words whose ids a worker remembers, and the text a task turns into ids at once.
KNOWN_WORDS, TEXT_BYTES = 300_000, 8 * 1024 * 1024
# The tokenizer's word pattern on lower-case ASCII text without white space.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in set(_PRINTED)]
BYTE_CHARS = {b: 256 + n for n, b in enumerate(_OTHERS)}

TOKENS = "doc_id bigint, part int, before bigint, n_tokens int, ids array<int>"


class Words:
    """Ids of words by one tokenizer; one object a worker and file."""

    _open: dict[str, Words] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.int32)
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _ids(self, word: str) -> list[int]:
        if word.isascii():
            if word.isalpha():
                return self._piece(word.lower())
            if "<|" not in word:  # special tokens are found before a word is cut
                ids = []
                for piece in PIECES.findall(word.lower()):
                    if piece not in self.pieces:
                        self.pieces[piece] = self._piece(piece.translate(BYTE_CHARS))
                    ids += self.pieces[piece]
                return ids
        elif word.isalpha() and unicodedata.is_normalized("NFC", word):
            low = "".join(map(str.lower, word))  # one by one: a final sigma is an ordinary one here
            if low.isalpha():
                return self._piece(low.encode().decode("latin-1").translate(BYTE_CHARS))
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def word_ids(self, word: str) -> bytes:
        """The packed ids of a word that is not known yet."""
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        if len(self.pieces) >= KNOWN_WORDS:
            self.pieces.clear()
        ids = self.known[word] = array(self.kind.char, self._ids(word)).tobytes()
        return ids

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with the end id; ids per text)."""
        # a mark after a letter or digit and before white space is a token of its own
        spaced = pc.replace_substring_regex(pc.fill_null(texts, ""), r"([\p{Ll}\p{N}A-Z])([.,])([ \n])", r"\1 \2\3")
        lists = pc.ascii_split_whitespace(spaced)
        words = lists.flatten().dictionary_encode()
        per_text = lists.value_lengths().to_numpy().astype(np.int64)
        vocabulary = words.dictionary.to_numpy(zero_copy_only=False)
        known, width = self.known, self.kind.itemsize
        packed = [known.get(w) or self.word_ids(w) for w in vocabulary if w] if len(vocabulary) else []
        if len(packed) < len(vocabulary):  # an empty word has no ids
            packed.insert(int(np.flatnonzero(vocabulary == "")[0]), b"")
        packed.append(np.array([end_id], self.kind).tobytes())
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // width
        flat = np.frombuffer(b"".join(packed), self.kind)
        starts = np.cumsum(lengths) - lengths
        # places of the end id among the words of all texts
        ends = np.cumsum(per_text)
        codes = np.insert(words.indices.to_numpy().astype(np.int64), ends, len(vocabulary))
        sizes = lengths[codes]
        total = np.cumsum(sizes)
        at = np.arange(total[-1], dtype=np.int32) + np.repeat((starts[codes] - total + sizes).astype(np.int32), sizes)
        bounds = np.concatenate([[0], total])[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]
        return flat[at].astype(np.int32), np.diff(bounds)


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before = Words.of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for cut in text_runs(batch.column(1), TEXT_BYTES):
                doc_ids, texts = batch.column(0)[cut], batch.column(1)[cut]
                ids, sizes = words.encode(texts, end_id)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids,
                        pa.array(np.full(len(sizes), part, np.int32)),
                        pa.array(before + ends - sizes),
                        pa.array(sizes.astype(np.int32)),
                        pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids)),
                    ],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(ends[-1])
        release_memory()

    return run


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def write_tokens(
    docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID,
    order: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> str:
    """Write the documents' ids as ORC files, in the order of ``order`` (document id); returns the folder."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    keys = {f"order_{n}": c for n, c in enumerate(order or [F.col(id_col).cast("bigint")])}
    keys["order_hash"] = F.xxhash64(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *[c.alias(k) for k, c in keys.items()])
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").select("doc_id", "text")
    ids = dealt.mapInArrow(_tokenize(tokenizer or tokenizer_path(), end_id), TOKENS)
    (
        ids.write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, before, n_tokens, ids``; documents of a part are in order of ``before``."""
    return spark.read.schema(TOKENS).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Token rows of some documents; stripes and row groups without them are skipped by index and Bloom filter."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        flat = lists.flatten().to_numpy().astype("<u4")
        ends = np.cumsum(lists.value_lengths().to_numpy())
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], lists.value_lengths().cast(pa.int64()), pa.array(sums, pa.int64())],
            names=["doc_id", "part", "before", "n_tokens", "ids_crc32"],
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    read = read_tokens(spark, path)
    parts = read.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file part
    bases = parts.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    sums = read.select("doc_id", "part", "before", "ids").mapInArrow(
        _checksums, "doc_id bigint, part int, before bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return sums.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
