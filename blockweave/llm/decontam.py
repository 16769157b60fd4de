"""Benchmark decontamination by spaced-seed hashing.

A seed mask looks at some positions of a run of tokens and ignores the others, so a hit survives
substitutions at the ignored positions. Every run of benchmark tokens is hashed under each mask, and so is
every run of a document; equal hashes are hits. A hit fixes how document and item lie against each
other. Around it the aligned tokens are compared: an overlap is a stretch that begins and ends with equal
tokens, is at least ``MIN_OVERLAP`` tokens long (or the whole item, if shorter) and has at least
``SIMILARITY`` equal tokens. The masks find nearly all stretches of ``MIN_OVERLAP`` tokens with substitutions (all
of 13, 14 and 18; 0.7 % of the patterns of 15 have no hit). A shorter item is cut into one piece more than it may have
substitutions, so one piece is whole in every overlap; the pieces are seeds of their own, and none is missed.

Benchmark items are a stated set: blocks of bounded size, each broadcast once, meet every document in one
pass without a shuffle. The word ids of a block's own vocabulary stand for tokens; any other word is
unknown and equals nothing.

Defined results: null or empty texts and items without words match nothing. Items of the same id are
separate texts of that id; repeated rows give repeated results; a null document id is kept as null.
Whole texts are read, only the named columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import BLOCK_BYTES, query_blocks
from blockweave.llm.words import mix, text_words

#: Seeds: 1 looks at a token, 0 ignores it. All have six looks; the spans differ, so that substitutions that hit
#: one seed rarely hit all.
MASKS = ("111111", "1101011001", "11001010011", "1010100100101", "1110001101")
MIN_OVERLAP, SIMILARITY = 13, 0.8
#: Words of documents that are compared with the seeds at once.
WORDS_AT_ONCE = 500_000
SCHEMA = "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, length bigint, equal bigint"


class SeedIndex:
    """Seed hashes of one block of items."""

    def __init__(
        self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS, min_overlap: int = MIN_OVERLAP, similarity: float = SIMILARITY
    ):
        self.masks = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in masks]
        self.span = max(map(len, masks))
        self.vocabulary: dict[str, int] = {}
        self.item_ids = [i for i, _ in items]
        ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text_words(t)], np.int32) for _, t in items]
        self.sizes = np.array([len(i) for i in ids], np.int64)
        gap = np.zeros(self.span, np.int32)
        self.starts = np.cumsum(self.sizes + self.span) - self.sizes
        self.tokens = np.concatenate([gap, *[x for i in ids for x in (i, gap)]])
        of = np.repeat(np.arange(len(ids)), self.sizes + self.span)
        self.of = np.concatenate([np.zeros(self.span, np.int64), of]).astype(np.int64)
        self.seeds = []
        short = self._pieces(min_overlap, similarity)
        for n, looks in enumerate([*self.masks, *map(np.arange, short)]):
            keys, places = self._hash(self.tokens, looks, n)
            if n >= len(self.masks):
                own = np.isin(places, short[len(looks)])
                keys, places = keys[own], places[own]
            order = np.argsort(keys, kind="stable")
            bits = 1 << max(10, int(np.ceil(np.log2(max(1, len(keys))))) + 4)
            bitmap = np.zeros(bits, bool)
            bitmap[keys & np.uint64(bits - 1)] = True
            self.seeds.append((looks, keys[order], places[order], bitmap))

    def _pieces(self, min_overlap: int, similarity: float) -> dict[int, list[int]]:
        """Places of the pieces of short items, by length."""
        found: dict[int, list[int]] = {}
        for start, size in zip(self.starts, self.sizes, strict=True):
            if 0 < size < min_overlap:
                pieces = int(size - np.ceil(similarity * size - 1e-9)) + 1
                cuts = np.linspace(0, size, pieces + 1).astype(int)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    found.setdefault(int(b - a), []).append(int(start + a))
        return found

    @staticmethod
    def _hash(tokens: np.ndarray, looks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all places where every looked-at token is a known word, and the places."""
        room = len(tokens) - int(looks[-1])
        if room <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        known = tokens > 0
        places = known[looks[0] : looks[0] + room].copy()
        for look in looks[1:]:
            places &= known[look : look + room]
        places = np.flatnonzero(places)
        keys = np.full(len(places), n + 1, np.uint64)
        for look in looks:
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + tokens[places + look].astype(np.uint64))
        return keys, places

    def diagonals(self, tokens: np.ndarray) -> np.ndarray:
        """Different (place in ``tokens`` minus place in the items, item) of all hits, one row each."""
        found = [np.empty((0, 2), np.int64)]
        for n, (looks, index, at, bitmap) in enumerate(self.seeds):
            keys, places = self._hash(tokens, looks, n)
            maybe = bitmap[keys & np.uint64(len(bitmap) - 1)] if len(keys) else np.empty(0, bool)
            keys, places = keys[maybe], places[maybe]
            first, last = np.searchsorted(index, keys, "left"), np.searchsorted(index, keys, "right")
            hits = last - first
            if hits.sum():
                mine = np.arange(hits.sum()) + np.repeat(first - (np.cumsum(hits) - hits), hits)
                item_at = at[mine]
                found.append(np.stack([np.repeat(places, hits) - item_at, self.of[item_at]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def compare(
        self, tokens: np.ndarray, low: int, high: int, offset: int, item: int, min_overlap: int, similarity: float
    ) -> tuple[int, int, int, int] | None:
        """The longest overlap along one diagonal inside [low, high) as (start, item start, length, equal)."""
        start, size = self.starts[item], self.sizes[item]
        a, b = max(low, start + offset), min(high, start + size + offset)
        equal = tokens[a:b] == self.tokens[a - offset : b - offset]
        places = np.flatnonzero(equal)
        need = min(min_overlap, size)
        if len(places) < similarity * need:
            return None
        # over stretches [first, last] of equal places: (n equal) >= similarity * length
        score = np.arange(len(places)) - similarity * places
        least = np.minimum.accumulate(score)  # the best first place up to each place
        best = None
        first = np.searchsorted(-least, -(score + 1 - similarity + 1e-9), "left")
        for last, f in enumerate(first):
            if f <= last and (best is None or places[last] - places[f] > places[best[1]] - places[best[0]]):
                best = (f, last)
        if best is None or places[best[1]] - places[best[0]] + 1 < need:
            return None
        f, last = best
        length = int(places[last] - places[f] + 1)
        return int(a + places[f] - low), int(a + places[f] - offset - start), length, int(last - f + 1)

    def overlaps(self, texts: list[str | None], min_overlap: int, similarity: float) -> Iterator[tuple[int, tuple]]:
        """(number of the text, (item id, document start, item start, length, equal)) of every overlap."""
        get, gap = self.vocabulary.get, [0] * self.span
        n = 0
        while n < len(texts):
            ids, bounds, first = [0] * self.span, [], n
            while n < len(texts) and len(ids) < WORDS_AT_ONCE:
                begin = len(ids)
                ids += [get(w, 0) for w in text_words(texts[n])]
                bounds.append((begin, len(ids)))
                ids += gap
                n += 1
            tokens = np.array(ids, np.int32)
            begins = np.array([b for b, _ in bounds])
            for offset, item in self.diagonals(tokens):
                # texts that this diagonal crosses
                low, high = self.starts[item] + offset, self.starts[item] + self.sizes[item] + offset
                for k in range(max(0, int(np.searchsorted(begins, low, "right")) - 1), int(np.searchsorted(begins, high))):
                    found = self.compare(tokens, *bounds[k], offset, item, min_overlap, similarity)
                    if found:
                        yield first + k, (self.item_ids[item], *found)


def _indexes(
    benchmark: DataFrame, id_col: str, text_col: str, masks: tuple[str, ...], min_overlap: int, similarity: float, limit: int
) -> Iterator[SeedIndex]:
    items = benchmark.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("item")
    )
    for block in query_blocks(items, F.col("item"), F.octet_length("item") * 8, limit):
        rows = sorted((r["item_id"] is not None, r["item_id"] or 0, r["item"]) for r in block.collect())
        yield SeedIndex([(i if known else None, t) for known, i, t in rows], masks, min_overlap, similarity)


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_overlap: int = MIN_OVERLAP,
    similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Every overlap: ``doc_id, item_id, doc_start, item_start, length, equal`` (places in words).

    One row for each way a document and an item lie against each other; its longest overlap counts.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    result = None
    for index in _indexes(benchmark, item_col, item_text_col, masks, min_overlap, similarity, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(shared.value.overlaps(batch.column(1).to_pylist(), min_overlap, similarity))
                where = pa.array([k for k, _ in found], pa.int64())
                columns = [batch.column(0).take(where)]
                columns += [pa.array([row[c] for _, row in found], pa.int64()) for c in range(5)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "doc_start", "item_start", "length", "equal"])

        found = rows.mapInArrow(find, SCHEMA)
        result = found if result is None else result.unionByName(found)
    return result


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_overlap: int = MIN_OVERLAP,
    similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item; all columns are kept, nothing is shuffled."""
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, item_col, item_text_col, masks, min_overlap, similarity, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for k, _ in shared.value.overlaps(batch.column(at).to_pylist(), min_overlap, similarity):
                    clean[k] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
