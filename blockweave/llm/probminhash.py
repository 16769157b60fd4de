"""Near-duplicates by ProbMinHash signatures, banding and verification.

A document is a set of five-word shingles weighted by how often they occur. Each shingle is a Poisson process
with its weight as rate; an arrival hits a random register, and a register keeps the shingle that arrived first.
Two documents agree in a register with probability equal to their probability Jaccard similarity. Arrivals are
generated in order for all shingles of a batch at once, and a shingle stops as soon as its next arrival is later
than every register of its document. With all weights set to one the same code gives registers that agree with
probability equal to plain Jaccard. A document has both signatures; where no shingle is repeated they are the same.

1. Documents with the same words are one exact class; its smallest id stands for it.
2. Both signatures are cut into bands, and a band's bucket is named by number and registers, of whichever signature. In every bucket each member is paired with the smallest one (a star), pairs
   are verified on the texts, and verified links form components.
3. In buckets that still hold several components, members of different components are compared, block against
   block, by longer signatures of both kinds; the pairs that come near in either are verified too. So no pair that shares a
   bucket is passed over unless it is already in one class.

A link is a pair whose probability Jaccard or plain Jaccard similarity is at least ``SIMILARITY``. A class is a
connected component. Hot exact classes and buckets are never gathered: minima are combined before the
shuffle, joins back are splittable by adaptive execution, and blocks of a bucket are bounded.

Defined results: rows without an id take no part. Null texts are empty; texts without words are in one class
if their characters are equal. Shorter texts than five words are one shingle. Each row gives a row: rows with the
same id and the same words have the same class, rows with one id and different texts that of their own text, so an
id may then have several (``keep_one`` keeps one row of such an id if it stands for a class, whichever comes first).
An empty table gives none. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import release_memory, text_runs, written
from blockweave.llm.words import WordHashes, hashed, mix, shingles, text_words

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 8
REGISTERS = BANDS * ROWS
#: Registers of the longer signature by which members of different components are compared, and the share of
#: agreeing ones from which a pair is verified: the similarity less six standard errors.
LONG_REGISTERS = 1024
NEAR = SIMILARITY - 6 * (SIMILARITY * (1 - SIMILARITY) / LONG_REGISTERS) ** 0.5
#: Shingles and registers that a task works on at once, and arrivals of a round at least.
SHINGLES_AT_ONCE, ARRIVALS = 600_000, 60_000
#: Bytes of text that make a shingle, at least.
SHINGLE_BYTES = 5
#: Members of a bucket in a block.
BLOCK_ROWS = 256
_SEED = np.uint64(0x51_7C_C1_B7_27_22_0A_95)


def weighted(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of the different shingles of each document."""
    of = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((flat, of))
    of, flat = of[order], flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
    places = np.flatnonzero(new)
    return of[places], flat[places], np.diff(np.append(places, len(flat))).astype(float)


def signatures(of: np.ndarray, elements: np.ndarray, weights: np.ndarray, documents: int, registers: int = REGISTERS) -> np.ndarray:
    """First-arrived elements of each register, documents x registers; 0 where a document has none.

    ``registers`` is a power of two. A round makes one or more further arrivals for every live element; the
    arrivals of an element depend on the element alone, and its weight scales their times.
    """
    first = np.full(documents * registers, np.inf)
    kept = np.zeros(documents * registers, np.uint64)
    time, drawn = np.zeros(len(of)), 0
    while len(of):
        each = int(np.clip(ARRIVALS // len(of), 1, 256))
        numbers = np.arange(drawn + 1, drawn + each + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        random = mix((elements ^ _SEED)[:, None] + numbers[None, :])
        gaps = -np.log1p(-(random >> np.uint64(11)).astype(float) * 2.0**-53) / weights[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        register = (mix(random) & np.uint64(registers - 1)).astype(np.int64)
        places = (of[:, None] * registers + register).ravel()
        arrived = times.ravel()
        np.minimum.at(first, places, arrived)
        won = arrived == first[places]
        kept[places[won]] = np.broadcast_to(elements[:, None], times.shape).ravel()[won]
        live = np.unique(of)
        latest = np.zeros(documents)
        latest[live] = first.reshape(documents, registers)[live].max(axis=1)
        time, drawn = times[:, -1], drawn + each
        alive = time < latest[of]
        of, elements, weights, time = of[alive], elements[alive], weights[alive], time[alive]
    return kept.reshape(documents, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of probability Jaccard and plain Jaccard of two (sorted shingles, weights)."""
    (x, wx), (y, wy) = a, b
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if len(x) > len(y):
        (x, wx), (y, wy) = (y, wy), (x, wx)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    shared = y[at] == x
    common = x[shared]
    plain = len(common) / (len(x) + len(y) - len(common))
    if not len(common) or plain >= SIMILARITY or wx.max() == wy.max() == 1:
        return plain
    every = np.union1d(x, y)
    u, v = np.zeros(len(every)), np.zeros(len(every))
    u[np.searchsorted(every, x)], v[np.searchsorted(every, y)] = wx, wy
    ratio = v[np.searchsorted(every, common)] / u[np.searchsorted(every, common)]
    # sum over common d of 1 / sum_e max(u_e / u_d, v_e / v_d), by sorting elements by v_e / u_e
    with np.errstate(divide="ignore"):
        turns = np.where(u > 0, v / np.where(u > 0, u, 1), np.inf)
    order = np.argsort(turns)
    below = np.concatenate([[0.0], np.cumsum(u[order])])
    above = np.concatenate([np.cumsum(v[order][::-1])[::-1], [0.0]])
    cut = np.searchsorted(turns[order], ratio, "right")
    uc, vc = u[np.searchsorted(every, common)], v[np.searchsorted(every, common)]
    return max(plain, float((1 / (below[cut] / uc + above[cut] / vc)).sum()))


def _runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for n, size in enumerate(sizes):
        if n > start and total + size > limit:
            yield start, n
            start, total = n, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def class_key(text: str | None) -> bytes:
    words = text_words(text)
    return xxhash.xxh3_128_digest(" ".join(words) if words else "\0" + (text or ""))


def _signed(texts: list[str | None], hashes: WordHashes, registers: int) -> list[pa.Array]:
    """The weighted and the plain signature, sixteen bits of every register as bytes.

    Both are null for a text without words; the plain one also where no shingle is repeated, as it is the same.
    """
    of, elements, weights = weighted(*shingles(*hashed(texts, hashes), WIDTH))
    some, repeated = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
    some[of] = True
    repeated[of[weights > 1]] = True
    again = repeated[of]
    kinds = [(some, of, elements, weights), (repeated, of[again], elements[again], np.ones(int(again.sum())))]
    columns = []
    for has, *parts in kinds:
        kept = (mix(signatures(*parts, len(texts), registers)) & np.uint64(0xFFFF)).astype("<u2")
        columns.append(pa.array([kept[k].tobytes() if has[k] else None for k in range(len(texts))], pa.binary()))
    return columns


def _signer(registers: int, names: list[str], with_class: bool):
    """Rows (id, text) to signatures, a bounded number of shingles and registers at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in text_runs(batch.column(1), SHINGLES_AT_ONCE * SHINGLE_BYTES, registers * SHINGLE_BYTES):
                texts = batch.column(1)[part].to_pylist()
                keys = [pa.array([class_key(t) for t in texts], pa.binary())] if with_class else []
                columns = [batch.column(0)[part], *keys, *_signed(texts, hashes, registers)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release_memory()

    return run


_sign = _signer(REGISTERS, ["doc_id", "cls", "signature", "plain"], True)
_sign_long = _signer(LONG_REGISTERS, ["rep", "signature", "plain"], False)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b): those that are similar. Each different text of a run is shingled once."""
    hashes = WordHashes()
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        sizes = pc.add(*(pc.fill_null(pc.binary_length(batch.column(c)), 0) for c in (2, 3))).to_numpy() // 5
        for low, high in _runs(sizes.tolist(), SHINGLES_AT_ONCE):
            both = pa.concat_arrays([pc.fill_null(batch.column(c)[low:high], "") for c in (2, 3)]).dictionary_encode()
            texts = both.dictionary.to_pylist()
            of, elements, weights = weighted(*shingles(*hashed(texts, hashes), WIDTH))
            ends = np.searchsorted(of, np.arange(len(texts) + 1))
            sets = [(elements[p:q], weights[p:q]) for p, q in zip(ends[:-1], ends[1:], strict=True)]
            codes = both.indices.to_numpy().reshape(2, -1)
            for n, (x, y) in enumerate(codes.T, low):
                keep[n] = similarity(sets[x], sets[y]) >= SIMILARITY
        yield batch.select([0, 1]).filter(pa.array(keep))
    release_memory()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The similar ones of ``pairs`` (a, b); ``texts`` has (doc_id, text). Written."""
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    met = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    return written(met.mapInArrow(_verify, "a bigint, b bigint").distinct(), "near-links")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``links`` (a, b): the smallest id it is connected to.

    Large stars and small stars by turns: every id points its larger, then its smaller neighbours to the
    smallest one, until nothing changes. Each turn is written.
    """
    pairs = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = written(pairs, "stars"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small_least.select("u", F.col("m").alias("v"))
        )
        pairs = written(small.distinct(), "stars")
        state = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u")).first())
        if state == before and state[0] == state[2] or not state[0]:
            break
        before = state
    linked = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return linked.unionByName(linked.select(F.col("component").alias("id"), "component").distinct())


def _both(rows: pd.DataFrame, weighted: str, plain: str, *shape: int) -> list[np.ndarray]:
    """Signatures of the two kinds as arrays; a missing plain one is the same as the weighted one."""
    kinds = (rows[weighted], rows[plain].where(rows[plain].notna(), rows[weighted]))
    return [np.frombuffer(b"".join(kind), "<u2").reshape(len(rows), *shape) for kind in kinds]


def _across(rows: pd.DataFrame) -> pd.DataFrame:
    """Near pairs of different components in two blocks of a bucket; a pair counts in its first common band only."""
    signed = _both(rows, "signature", "plain", -1)
    bands = _both(rows, "bands", "plain_bands", BANDS, ROWS)
    band = rows["band"].iat[0]
    ids, component, block = (rows[c].to_numpy() for c in ("rep", "component", "block"))
    first, second = rows["i"].iat[0], rows["j"].iat[0]
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    a, b = [], []
    for k in left:
        others = right[(component[right] != component[k]) & ((ids[right] > ids[k]) if first == second else True)]
        near = others[np.any([(kind[others] == kind[k]).mean(axis=1) >= NEAR for kind in signed], axis=0)]
        for x in bands:
            for y in bands:  # a bucket takes both kinds
                near = near[(x[near, :band] == y[k, :band]).all(axis=2).sum(axis=1) == 0]
        a += [min(ids[k], x) for x in ids[near]]
        b += [max(ids[k], x) for x in ids[near]]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, exact_id`` of every document with an id.

    ``class_id`` is the smallest id of the near-duplicate class, ``exact_id`` that of the documents with the same words.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(rows.mapInArrow(_sign, "doc_id bigint, cls binary, signature binary, plain binary"), "near-signatures")
    reps = signed.groupBy("cls").agg(F.min(F.struct("doc_id", "signature", "plain")).alias("r"))
    reps = written(reps.select("cls", F.col("r.doc_id").alias("rep"), "r.signature", "r.plain"), "near-reps")

    width = 2 * ROWS
    cut = lambda n: F.array_compact(F.array_distinct(F.array(*(F.substring(c, n * width + 1, width) for c in ("signature", "plain")))))
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), cut))
    banded = reps.where(F.col("signature").isNotNull()).select("rep", band.alias("band", "parts"))
    banded = banded.select("rep", "band", F.explode("parts").alias("part"))
    banded = banded.select("rep", "band", F.xxhash64("band", "part").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("n"))
    members = written(banded.join(buckets.where("most > least"), "bucket").select("bucket", "band", "rep", "least", "n"), "near-buckets")

    stars = written(members.where("rep != least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct(), "near-stars")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = written(rows.join(wanted, "doc_id", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).drop("h"), "near-texts")
    links = verified(stars, texts)
    found = written(components(links), "near-components")

    # Buckets of three and more that hold several components.
    labelled = members.where("n > 2").join(found, F.col("rep") == F.col("id"), "left").select(
        "bucket", "band", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    across = labelled.join(mixed, "bucket").select("bucket", "band", "rep", "component", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    signs = texts.join(across.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    signs = signs.select("doc_id", "text").mapInArrow(_sign_long, "rep bigint, signature binary, plain binary").where("signature is not null")
    across = across.join(reps.select("rep", F.col("signature").alias("bands"), F.col("plain").alias("plain_bands")), "rep").join(signs, "rep").withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    across = across.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    near = across.groupBy("bucket", "i", "j").applyInPandas(_across, "a bigint, b bigint").distinct()
    near = written(near.join(stars, ["a", "b"], "left_anti"), "near-across")
    if not near.isEmpty():
        found = written(components(links.unionByName(verified(near, texts))), "near-components")

    classes = reps.join(found, F.col("rep") == F.col("id"), "left").select(
        "cls", F.col("rep").alias("exact_id"), F.coalesce("component", "rep").alias("class_id")
    )
    return signed.select("doc_id", "cls").join(classes, "cls").select("doc_id", "class_id", "exact_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest id; rows without an id are all kept."""
    classes = near_duplicates(docs, id_col, text_col)
    keepers = classes.where("doc_id = class_id").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.where(F.col(id_col).isNotNull())
    kept = named.join(keepers, named[id_col].cast("bigint") == keepers["kept_id"], "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
