"""A Merkle manifest of a dataset: leaf places by ranks in merged bitmaps, levels by keyed slot arrays.

A row is a leaf, the hash of its fields. The leaves of a group (``lang``) are ordered by document id, and runs of two
become their hash until one is left, the group's subroot. Subroots, in order of group, go the same way to the root.

1. Places. Tasks put the ids they read into compressed containers of 2**16 ids (array, bitmap or runs, whichever is
   smallest); the containers of a group and id range are merged. Popcount directories over the containers, in levels of
   1,024 so that no group of rows grows, say how many ids come before each container, and a rank query in the container
   (directory of its words, popcount of the rest) gives a leaf its place. Leaves are never sorted by id.
2. Levels. Leaves meet in slot arrays of 4,096 places, keyed by group and place, which reduce twelve levels at once and give
   each slot its siblings. Their top nodes are the slots of the next round, so the number of shuffles grows with the
   logarithm of the rows to the base 4,096.
3. Proofs. A leaf's siblings are those of its slot array, then those of the arrays above. The fold starts from the
   leaf as it is now (``tampered`` where it differs) and must end at the root.

Defined results: a null field counts as ``-``; an absent column as null. Null groups come first, then by UTF-8 bytes. Rows
without an id come before all others of their group. Rows that share an id (or have none) stand in order of leaf, so
repeated rows take places of their own. A group of one leaf has it as subroot, a lone subroot is the root; without siblings the proof is
the hash of nothing. An empty table gives no rows. Only the named fields are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.llm.common import written
from blockweave.operators.numbering import numbered
from blockweave.session import BROADCAST_BYTES

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of an id inside a container, of a container inside a directory block, of a place inside a slot array.
LOW_BITS, DIRECTORY_BITS, SLOT_BITS = 16, 10, 12
#: Ids a task holds before it passes its containers on.
HELD_IDS = 1 << 20
#: Leading hex digits of a leaf by which the rows of one id are dealt.
DEAL_DIGITS = 3
NO_IDS = -1


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(values: list[Column]) -> Column:
    """Hash of the fields: ``-`` if null, else length in bytes, a colon, and the value."""
    def coded(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(coded, values)), 256)


def group_key(group: Column) -> Column:
    """A key without nulls in the order of the groups."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


# Containers: a letter for the kind, then 16-bit little-endian numbers or bits.


def to_container(lows: np.ndarray) -> bytes:
    """Ascending different numbers below 2**16 in the smallest of three forms."""
    breaks = np.flatnonzero(np.diff(lows.astype(np.int64)) != 1)
    runs = len(breaks) + 1
    if 4 * runs <= min(2 * len(lows), 1 << 13):
        first, last = lows[np.concatenate([[0], breaks + 1])], lows[np.concatenate([breaks, [len(lows) - 1]])]
        return b"R" + np.stack([first, last], axis=1).astype("<u2").tobytes()
    if 2 * len(lows) <= 1 << 13:
        return b"A" + lows.astype("<u2").tobytes()
    bits = np.zeros(1 << LOW_BITS, bool)
    bits[lows] = True
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def container_words(container: bytes) -> np.ndarray:
    """The bitmap of a container as 1,024 words."""
    kind, body = container[:1], container[1:]
    if kind == b"B":
        return np.frombuffer(body, "<u8").copy()
    bits = np.zeros((1 << LOW_BITS) + 1, np.int8)
    numbers = np.frombuffer(body, "<u2").astype(np.int64)
    if kind == b"A":
        bits[numbers] = 1
    else:
        np.add.at(bits, numbers[0::2], 1)
        np.add.at(bits, numbers[1::2] + 1, -1)
        bits = np.cumsum(bits, dtype=np.int8)
    return np.packbits(bits[:-1].astype(bool), bitorder="little").view("<u8").copy()


def ranks(words: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """How many members of a bitmap are below each of ``lows``."""
    directory = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    word, bit = lows >> 6, (lows & 63).astype(np.uint64)
    below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
    return directory[word] + np.bitwise_count(below)


CONTAINERS = "grp string, bucket bigint, container binary, again binary"


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, doc_id) to containers; ``again`` holds the ids met more than once: (low, further times)."""
    held: list[pa.RecordBatch] = []

    def release() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        groups = table.column(0).combine_chunks().dictionary_encode()
        ids = table.column(1).to_numpy()
        buckets = ids >> LOW_BITS
        order = np.lexsort((ids, groups.indices.to_numpy()))
        code, bucket, low = groups.indices.to_numpy()[order], buckets[order], ids[order] & ((1 << LOW_BITS) - 1)
        new = np.ones(len(order), bool)
        new[1:] = (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])
        starts = np.flatnonzero(new)
        bodies, again = [], []
        for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
            lows, times = np.unique(low[a:b], return_counts=True)
            bodies.append(to_container(lows))
            again.append(_again(lows, times - 1))
        names = groups.dictionary.take(pa.array(code[starts]))
        columns = [names, pa.array(bucket[starts]), pa.array(bodies, pa.binary()), pa.array(again, pa.binary())]
        held.clear()
        yield pa.RecordBatch.from_arrays(columns, names=["grp", "bucket", "container", "again"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD_IDS:
            yield from release()
    if sum(b.num_rows for b in held):
        yield from release()


def _again(lows: np.ndarray, times: np.ndarray) -> bytes:
    more = times > 0
    return np.stack([lows[more], times[more]], axis=1).astype("<i8").tobytes()


def _pairs(again: bytes) -> np.ndarray:
    return np.frombuffer(again, "<i8").reshape(-1, 2)


MERGED = CONTAINERS + ", ids bigint"


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """One container of all that name the same ids: their union, and how often each id occurs beyond once."""
    words = np.zeros(1 << LOW_BITS - 6, np.uint64)
    total = np.zeros(1 << LOW_BITS, np.int64)
    for container, again in zip(table["container"], table["again"], strict=True):
        mine = container_words(container.as_py())
        both = np.unpackbits((words & mine).view(np.uint8), bitorder="little")
        total += both  # an id that was there already
        words |= mine
        pairs = _pairs(again.as_py())
        np.add.at(total, pairs[:, 0], pairs[:, 1])
    lows = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
    cells = [key[0].as_py(), key[1].as_py(), to_container(lows), _again(lows, total[lows]), len(lows) + int(total.sum())]
    types = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    return pa.table([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=["grp", "bucket", "container", "again", "ids"])


def directory(counts: DataFrame) -> DataFrame:
    """``grp, bucket, start, n``: ids of the group before each bucket, and in all of it, from (grp, bucket, ids).

    A level sums blocks of 1,024 buckets; levels are added until a group is one block.
    """
    low = counts.agg(F.min("bucket")).first()[0] or 0
    levels = [counts.select("grp", (F.col("bucket") - low).alias("key"), F.col("ids").alias("n"))]
    above = lambda key: F.shiftright(key, DIRECTORY_BITS)
    while (levels[-1].groupBy("grp").count().agg(F.max("count")).first()[0] or 0) > 1:
        summed = levels[-1].groupBy("grp", above("key").alias("key")).agg(F.sum("n").alias("n"))
        levels.append(written(summed, "directory"))
    found = levels[-1].select("grp", "key", F.lit(0).cast("bigint").alias("start"), F.col("n").alias("all"))
    for level in reversed(levels[:-1]):
        earlier = Window.partitionBy("grp", above("key")).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        inside = level.select("grp", "key", above("key").alias("up"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        parent = found.select("grp", F.col("key").alias("up"), "start", "all")
        found = inside.join(parent, ["grp", "up"]).select("grp", "key", (F.col("start") + F.col("before")).alias("start"), "all")
    return found.select("grp", (F.col("key") + low).alias("bucket"), "start", F.col("all").alias("n"))


PLACED = "doc_id bigint, grp string, leaf string, tampered string, pos bigint, n bigint"


def _rank(leaves: pa.Table, entry: pa.Table) -> pa.Table:
    """Places of the leaves of one container."""
    if not leaves.num_rows:
        return pa.table([pa.array([], f.type) for f in _schema(PLACED)], schema=_schema(PLACED))
    ids = leaves["doc_id"].to_numpy()
    lows = ids & ((1 << LOW_BITS) - 1)
    pos = entry["start"][0].as_py() + ranks(container_words(entry["container"][0].as_py()), lows)
    more = _pairs(entry["again"][0].as_py())
    earlier = np.concatenate([[0], np.cumsum(more[:, 1])])
    pos = pos + earlier[np.searchsorted(more[:, 0], lows)]
    n = pa.array(np.full(len(ids), entry["n"][0].as_py(), np.int64))
    return pa.table([*(leaves[c] for c in ("doc_id", "grp", "leaf", "tampered")), pa.array(pos.astype(np.int64)), n], schema=_schema(PLACED))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _starts_of_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First place of every id of the directory that occurs more than once."""
    for batch in batches:
        for grp, bucket, container, again, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs = _pairs(again)
            if len(pairs):
                first = start + ranks(container_words(container), pairs[:, 0]) + np.cumsum(pairs[:, 1]) - pairs[:, 1]
                ids = (bucket << LOW_BITS) + pairs[:, 0]
                columns = [pa.array([grp] * len(ids)), pa.array(ids), pa.array(first.astype(np.int64)), pa.array([n] * len(ids), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["grp", "doc_id", "first", "n"])


def placed_leaves(leaves: DataFrame) -> DataFrame:
    """``doc_id, grp, leaf, tampered`` with each leaf's place and the number of leaves of its group. Written."""
    named = leaves.where("doc_id is not null")
    nameless = leaves.where("doc_id is null")
    partial = named.select("grp", "doc_id").mapInArrow(_containers, CONTAINERS)
    merged = written(partial.groupBy("grp", "bucket").applyInArrow(_merged, MERGED), "id-bitmaps")
    first_bucket = merged.agg(F.min("bucket")).first()[0] or 0
    none = nameless.groupBy("grp").agg(F.count("*").alias("ids")).select("grp", F.lit(first_bucket - 1).alias("bucket"), "ids")
    starts = written(directory(written(merged.select("grp", "bucket", "ids").unionByName(none), "id-counts")), "directory")
    entries = merged.drop("ids").join(starts, ["grp", "bucket"])

    single, several = named, nameless.withColumns({"first": F.lit(0).cast("bigint"), "n": F.lit(0).cast("bigint")}).limit(0)
    repeats = written(entries.mapInArrow(_starts_of_repeats, "grp string, doc_id bigint, first bigint, n bigint"), "repeated-ids")
    if not repeats.isEmpty():
        single = named.join(repeats.select("grp", "doc_id"), ["grp", "doc_id"], "left_anti")
        several = named.join(repeats, ["grp", "doc_id"])
    if not nameless.isEmpty():
        heads = starts.where(F.col("bucket") == first_bucket - 1).select("grp", F.col("start").alias("first"), "n")
        several = several.unionByName(nameless.join(heads, "grp"), allowMissingColumns=True)
    bucket = F.shiftright("doc_id", LOW_BITS)
    ranked = (
        single.select("doc_id", "grp", "leaf", "tampered", bucket.alias("bucket")).groupBy("grp", "bucket")
        .cogroup(entries.groupBy("grp", "bucket")).applyInArrow(_rank, PLACED)
    )
    return written(ranked.unionByName(_in_order_of_leaf(several)), "placed-leaves")


def _in_order_of_leaf(rows: DataFrame) -> DataFrame:
    """Places of rows that share an id, from its ``first`` place on. Equal rows are counted, not gathered."""
    rows = rows.select("doc_id", "grp", "leaf", "tampered", "first", "n", F.substring("leaf", 1, DEAL_DIGITS).alias("deal"))
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))
    one = [F.col("grp"), F.coalesce("doc_id", F.lit(NO_IDS)), F.col("doc_id").isNull()]
    deals = equal.groupBy("grp", "doc_id", "deal").agg(F.sum("times").alias("times"))
    before = Window.partitionBy(*one).orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    deals = deals.select(
        F.col("grp").alias("g"), F.col("doc_id").alias("i"), F.col("deal").alias("d"), F.coalesce(F.sum("times").over(before), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy(*one, "deal").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    met = equal.withColumn("inside", F.coalesce(F.sum("times").over(inside), F.lit(0))).join(
        deals, (F.col("grp") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("deal") == F.col("d"))
    )
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1))
    return met.withColumn("step", step).select(
        "doc_id", "grp", "leaf", "tampered", (F.col("first") + F.col("before") + F.col("inside") + F.col("step")).alias("pos"), "n"
    )


# Levels.

SLOTS = "doc_id bigint, grp string, leaf string, tampered string, pos bigint, n bigint, path string, top boolean"


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    return max(0, (n - 1).bit_length())


def reduce_slots(nodes: list[str], levels: int) -> tuple[str, list[str]]:
    """The node above a slot array after ``levels`` levels, and every slot's siblings on the way."""
    paths = [""] * len(nodes)
    for level in range(levels):
        for k in range(len(paths)):
            beside = (k >> level) ^ 1
            if beside < len(nodes):
                paths[k] += nodes[beside]
        nodes = [sha256_hex("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
    return nodes[0], paths


def _reduce(table: pa.Table) -> pa.Table:
    """One slot array: its leaves with their siblings, and one row for the node on top of it."""
    pos = table["pos"].to_numpy()
    slot = pos & ((1 << SLOT_BITS) - 1)
    by_slot = np.argsort(slot)  # places of the array's own slots, each taken once
    if (slot[by_slot] != np.arange(len(slot))).any():
        raise ValueError("places of a slot array are not 0, 1, 2, ...")
    n = table["n"][0].as_py()
    table = table.take(pa.array(by_slot))
    top, paths = reduce_slots(table["leaf"].to_pylist(), min(SLOT_BITS, levels_of(n)))
    rows = table.append_column("path", pa.array(paths, pa.string())).append_column("top", pa.array(np.zeros(len(slot), bool)))
    above = {
        "doc_id": None, "grp": table["grp"][0].as_py(), "leaf": top, "tampered": None, "pos": int(pos[0]) >> SLOT_BITS,
        "n": (n + (1 << SLOT_BITS) - 1) >> SLOT_BITS, "path": "", "top": True,
    }
    return pa.concat_tables([rows.select(_schema(SLOTS).names).cast(_schema(SLOTS)), pa.Table.from_pylist([above], _schema(SLOTS))])


def reduce_levels(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (PLACED) with their siblings up to the top of their group (``path``), and (grp, top node) of each group."""
    arrays = written(nodes.groupBy("grp", F.shiftright("pos", SLOT_BITS)).applyInArrow(_reduce, SLOTS), "slot-arrays")
    rows, tops = arrays.where("not top").drop("top"), arrays.where("top").drop("top", "path")
    if tops.where("n > 1").isEmpty():
        return rows, tops.select("grp", F.col("leaf").alias("node"))
    more, done = tops.where("n > 1"), tops.where("n = 1").select("grp", F.col("leaf").alias("node"))
    upper, roots = reduce_levels(more)
    upper = upper.select(F.col("grp").alias("g"), F.col("pos").alias("up"), F.col("path").alias("rest"))
    if (upper.agg(F.sum(F.octet_length("rest") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        upper = F.broadcast(upper)
    met = rows.join(upper, (F.col("grp") == F.col("g")) & (F.shiftright("pos", SLOT_BITS) == F.col("up")), "left")
    rows = met.select(*[c for c in rows.columns if c != "path"], F.concat("path", F.coalesce("rest", F.lit(""))).alias("path"))
    return rows, roots.unionByName(done)


def fold(node: str, path: str, pos: int, n: int) -> str:
    """The node on top, from a node at ``pos`` of ``n`` and its siblings."""
    at = 0
    while n > 1:
        if pos ^ 1 < n:
            beside = path[at : at + 64]
            at += 64
            node = sha256_hex(beside + node if pos & 1 else node + beside)
        else:
            node = sha256_hex(node)
        pos, n = pos >> 1, n + 1 >> 1
    return node


PROVED = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        proofs, folded = [], []
        names = ("leaf", "tampered", "path", "pos", "n", "upper", "place", "groups")
        for leaf, tampered, path, pos, n, upper, place, groups in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            proofs.append(sha256_hex(path + upper))
            folded.append(fold(fold(leaf if tampered is None else tampered, path, pos, n), upper, place, groups))
        same = [a == b for a, b in zip(folded, batch.column("root").to_pylist(), strict=True)]
        kept = [batch.column(c) for c in ("doc_id", "leaf", "subroot", "root")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(proofs), pa.array(folded), pa.array(same)], schema=_schema(PROVED))


def manifest(leaves: DataFrame) -> DataFrame:
    """Proofs of all leaves ``(doc_id, grp, leaf, tampered)``; ``tampered`` is the leaf as it is now, null if unchanged."""
    rows, subroots = reduce_levels(placed_leaves(leaves))
    ordered = numbered(subroots, "grp", name="pos")
    count = ordered.count()
    if not count:
        return rows.sparkSession.createDataFrame([], PROVED)
    top = ordered.select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit("").alias("grp"), F.col("node").alias("leaf"), F.col("grp").alias("tampered"),
        "pos", F.lit(count).cast("bigint").alias("n"),
    )
    groups, roots = reduce_levels(top)
    root = roots.first()["node"]
    above = groups.select(
        F.col("tampered").alias("g"), F.col("leaf").alias("subroot"), F.col("path").alias("upper"), F.col("pos").alias("place"),
        F.col("n").alias("groups"),
    )
    if (above.agg(F.sum(F.octet_length("upper") + F.octet_length("g") + 200)).first()[0] or 0) <= BROADCAST_BYTES:
        above = F.broadcast(above)
    met = rows.join(above, F.col("grp") == F.col("g")).select(
        "doc_id", "leaf", "tampered", "path", "pos", "n", "subroot", "upper", "place", "groups", F.lit(root).alias("root")
    )
    return met.mapInArrow(_prove, PROVED)


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """A leaf for every document, and its leaf with ``n_chars`` one higher where ``tampered`` holds. Written."""
    kinds = {"doc_id": "bigint", "n_chars": "bigint"}
    value = {c: (F.col(c) if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")) for c in FIELDS}
    changed = {**value, "n_chars": value["n_chars"].cast("decimal(20,0)") + 1}
    hashed = [leaf_hash([one[c] for c in FIELDS]) for one in (value, changed)]
    now = F.when(tampered & value["n_chars"].isNotNull(), hashed[1]) if tampered is not None else F.lit(None).cast("string")
    leaves = docs.select(value["doc_id"].alias("doc_id"), group_key(value["lang"]).alias("grp"), hashed[0].alias("leaf"), now.alias("tampered"))
    return written(leaves, "leaves")


def every_seventh(doc_id: Column) -> Column:
    """Whether 7 divides the crc32 of the decimal id."""
    return F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % 7 == 0
