"""Repeated word sequences: Rabin-Karp hashes of every window of ``WIDTH`` words, counted, merged to intervals.

The words of a text are hashed once per different word. A window's hash is a polynomial in its words' hashes; powers of
the base and a running sum over a run of texts give all windows of the run in a few array operations (arithmetic
modulo 2**64). A window is named by 80 bits of two such polynomials: among n windows about n**2 / 2**81 pairs agree by
chance, 1e-5 in 30 GB of text.

1. A task works on runs of whole texts of about ``RUN_BYTES``. Of the documents of a run that hold the same window,
   the one with the smallest id is sent on; the others are known to be repeats then and there, so a passage that
   many documents share is sent once a run, not once a document. Windows go to the bucket that their upper bits name, each
   bucket's windows of a run as one packed row (sorted hashes, document, place).
2. A bucket finds the windows that several runs sent and passes on the places that a smaller document also has. The number
   of buckets follows the amount of text, so a bucket stays at a few million windows.
3. Places are gathered by document and merged into maximal removal intervals, which meet the texts again:
   broadcast if their counted size is small, by a shuffle join otherwise.

Defined results: a null or empty text has no words. Rows without an id keep all words and count for nobody. Rows with
the same id are one document: they do not remove each other's words, and each row is judged on its own text.
Repeated rows each give a row. Texts shorter than the window keep all words. An empty table gives no rows. Only the two
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockweave.llm.common import text_runs, written
from blockweave.session import BROADCAST_BYTES

WIDTH = 13
#: Bytes of text that a task hashes at once; a longer text is a run of its own.
RUN_BYTES = 4 << 20
#: Bytes of text whose windows make up a bucket.
BUCKET_BYTES = 16 << 20
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
#: Places of a second text with the same id start at the next multiple of this.
TEXT_STEP = 1 << 32
CODEC = "zstd"
PACKED = "bucket int, known boolean, n int, payload binary"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words one after another, words per text); words are runs without ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, of = lists.flatten(), np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
    some = pc.not_equal(words, "")
    return words.filter(some), np.bincount(of[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def word_hashes(words: pa.Array) -> np.ndarray:
    """Two 64-bit hashes of every word, 2 x words."""
    coded = words.dictionary_encode()
    digests = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist()))
    return np.frombuffer(digests, "<u8").reshape(-1, 2).T[:, coded.indices.to_numpy()]


def window_hashes(hashes: np.ndarray, base: np.uint64, width: int) -> np.ndarray:
    """Sum over k of h[i + k] * base**(width - 1 - k) modulo 2**64 for every window of ``width`` hashes."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    powers = np.ones(n + width, np.uint64)
    powers[1:] = base
    falling = np.ones(n, np.uint64)
    falling[1:] = inverse
    powers, falling = np.cumprod(powers), np.cumprod(falling)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * falling, out=running[1:])
    # h[j] * base**-j summed over the window, times base**(i + width - 1)
    return (running[width:] - running[:-width]) * powers[width - 1 : n]


def windows(words: pa.Array, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, further 16 bits, text, place in the text) of every window inside a text."""
    first, second = word_hashes(words)
    h, c = window_hashes(first, BASES[0], width), window_hashes(second, BASES[1], width)
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = (place + width <= sizes[of])[: len(h)]
    return h[inside], (c[inside] >> np.uint64(48)), of[: len(h)][inside], place[: len(h)][inside]


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers of 64 bits by byte planes, compressed: planes that hardly change take little room."""
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec=CODEC, asbytes=True)


def unpack(payload: bytes, n: int, columns: int) -> np.ndarray:
    raw = pa.decompress(payload, 64 * n * columns // 8, codec=CODEC, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u8").reshape(columns, n)


def smallest_of_equal(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows by hash, and for each in this order the smallest document among equal windows."""
    order = np.lexsort((doc, c, h))
    h, c, doc = h[order], c[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    starts = np.flatnonzero(new)
    return order, np.repeat(doc[starts], np.diff(np.append(starts, len(h))))


def _send(width: int, buckets: int, run_bytes: int):
    """Rows (doc_id, tag, text) to packed windows, one row a run and bucket."""
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def bucket_of(h: np.ndarray) -> np.ndarray:
        return (h >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)

    def rows(bucket: np.ndarray, known: bool, columns: list[np.ndarray]) -> pa.RecordBatch:
        # ``bucket`` ascends
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket)) if len(bucket) else np.empty(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        payloads = [pack(*(c[a:b] for c in columns)) for a, b in zip(starts, ends, strict=True)]
        cells = [bucket[starts].astype(np.int32), np.full(len(starts), known), (ends - starts).astype(np.int32)]
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, cells), pa.array(payloads, pa.binary())], names=["bucket", "known", "n", "payload"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in text_runs(batch.column(2), run_bytes):
                ids, tags = (batch.column(c)[cut].to_numpy() for c in (0, 1))
                h, c, of, place = windows(*split_words(batch.column(2)[cut]), width)
                doc, place = ids[of], tags[of] * TEXT_STEP + place
                order, least = smallest_of_equal(h, c, doc)
                h, c, doc, place = h[order], c[order], doc[order], place[order]
                fresh = doc == least
                yield rows(bucket_of(h[fresh]), False, [h[fresh], c[fresh], doc[fresh], place[fresh]])
                # no other bucket has to hear of a known repeat: dealt by document
                doc, place = doc[~fresh], place[~fresh]
                bucket = bucket_of(doc.astype(np.uint64) * BASES[0])
                by = np.argsort(bucket, kind="stable")
                yield rows(bucket[by], True, [doc[by], place[by]])

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """All packed rows of a bucket to (doc_id, place) of windows that a smaller document has too."""
    found = []
    fresh = []
    for known, n, payload in zip(table["known"].to_pylist(), table["n"].to_pylist(), table["payload"].to_pylist(), strict=True):
        if known:
            found.append(unpack(payload, n, 2))
        else:
            fresh.append(unpack(payload, n, 4))
    if fresh:
        h, c, doc, place = np.concatenate(fresh, axis=1)
        fresh.clear()
        by = np.argsort(h)
        same = h[by][1:] == h[by][:-1]
        several = np.zeros(len(h), bool)
        several[by[1:]] |= same
        several[by[:-1]] |= same
        h, c, doc, place = h[several], c[several], doc[several].astype(np.int64), place[several]
        order, least = smallest_of_equal(h, c, doc)
        late = doc[order] > least
        found.append(np.stack([doc[order][late].astype(np.uint64), place[order][late]]))
    doc, place = np.concatenate(found, axis=1).astype(np.int64) if found else np.empty((2, 0), np.int64)
    return pa.table({"doc_id": doc, "place": place})


def intervals(places: np.ndarray, width: int) -> np.ndarray:
    """Maximal (begin, end) word intervals covered by windows at ``places``, flat."""
    places = np.unique(places)
    if not len(places):
        return places
    gap = np.flatnonzero(places[1:] > places[:-1] + width)
    begins = np.concatenate([places[:1], places[gap + 1]])
    ends = np.concatenate([places[gap], places[-1:]]) + width
    return np.stack([begins, ends], axis=1).reshape(-1)


def _merge(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            flat = lists.flatten().to_numpy()
            cuts = [intervals(flat[a:b], width) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.astype("<i8").tobytes() for c in cuts], pa.binary())], names=["id", "cuts"]
            )

    return run


def removal_intervals(
    docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
    run_bytes: int = RUN_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``id, cuts`` of the documents that lose words; written.

    ``cuts`` holds 64-bit word places, begin and end by turns. The places of a text are counted from its number
    among the different texts of the id times ``TEXT_STEP`` (0 where the id has one text).
    """
    rows, buckets = _tagged(docs, id_col, text_col), 1
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    while buckets * bucket_bytes < size:
        buckets *= 2
    sent = rows.where("doc_id is not null and text is not null").mapInArrow(_send(width, buckets, run_bytes), PACKED)
    places = sent.groupBy("bucket").applyInArrow(_repeats, "doc_id bigint, place bigint")
    gathered = places.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("place").alias("places"))
    return written(gathered.mapInArrow(_merge(width), "id bigint, cuts binary"), "removal-intervals")


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, tag, text``: the tag numbers the different texts of an id that has several."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = rows.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"))
    several = names.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high")
    several = written(several.select("doc_id"), "ids-of-several-texts")
    if several.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("bigint").alias("tag"), "text")
    numbered = names.join(several, "doc_id", "left_semi").distinct().withColumn(
        "tag", F.row_number().over(Window.partitionBy("doc_id").orderBy("h")).cast("bigint")
    )
    numbered = numbered.select(F.col("doc_id").alias("id"), F.col("h").alias("name"), "tag")
    same = (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("name"))
    return rows.join(numbered, same, "left").select("doc_id", F.coalesce("tag", F.lit(0)).alias("tag"), "text")


def _removed_words(sizes: np.ndarray, tags: np.ndarray, cuts: pa.Array) -> np.ndarray:
    """A mark for every word of a run of texts."""
    change = np.zeros(int(sizes.sum()) + 1, np.int64)
    starts = np.cumsum(sizes) - sizes
    for n in np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False)):
        pairs = np.frombuffer(cuts[int(n)].as_buffer(), "<i8").reshape(-1, 2) - tags[n] * TEXT_STEP
        pairs = pairs[(pairs[:, 0] >= 0) & (pairs[:, 1] <= sizes[n])]
        np.add.at(change, starts[n] + pairs[:, 0], 1)
        np.add.at(change, starts[n] + pairs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut in text_runs(batch.column(2), RUN_BYTES):
            words, sizes = split_words(batch.column(2)[cut])
            removed = _removed_words(sizes, batch.column(1)[cut].to_numpy(), batch.column(3)[cut])
            lost = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[removed], minlength=len(sizes))
            offsets = np.concatenate([[0], np.cumsum(sizes - lost)]).astype(np.int32)
            kept = pa.ListArray.from_arrays(offsets, words.filter(pa.array(~removed)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[cut], pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pc.binary_join(kept, " ")],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )


def remove_repeats(
    docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", **sizes: int
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row: the words that no smaller document's window covers."""
    cuts = removal_intervals(docs, width, id_col, text_col, **sizes)
    size = cuts.agg(F.sum(F.octet_length("cuts") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        cuts = F.broadcast(cuts)
    rows = _tagged(docs, id_col, text_col)
    met = rows.join(cuts, F.col("doc_id") == F.col("id"), "left").select("doc_id", "tag", "text", "cuts")
    return met.mapInArrow(_cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def removal_digest(removed: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
