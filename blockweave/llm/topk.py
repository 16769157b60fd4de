"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each dimension of a chunk of candidates is a sorted list, read from the end that serves the sign of the
query's component. All lists are read in step, deeper in each round, and each entry once: it raises its
candidate's lower bound (an unread component is at least the list's far end) by what it is above that end. Candidates
not yet seen score at most the sum of the last values read; while that reaches the k-th lower bound,
reading goes on. Then seen candidates get upper bounds (an unread component is at most the last value
read), and reading stops when few survivors (upper bound not below the k-th lower bound) are left; these get
their final scores. A chunk whose list heads stay below the k-th score reached before is not read. Where lists are
read to their end, the lower bounds are the scores.

Vectors become integers by floor(scale * x) first, and all bounds are integers below 2**53 in doubles, so
they are exact. Larger components are scored in Python integers instead (same result, and scores beyond
64 bits are clipped).

Queries are a stated set; blocks of bounded size meet every candidate once per block, and the rows found for a
block are written before the next one comes to the driver. Each task keeps k rows a query; these are merged by
score and id.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do
null ids; lengths must match the query's. A query leaves out the rows with its own id; of rows that repeat
a query's id the first vector in order is the query. Ties go to the smaller id; repeated candidate rows
each count. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.llm.common import BLOCK_BYTES, query_blocks, written

SCALE = 256
#: Candidates whose lists are sorted together, queries bounded together.
CHUNK, QUERIES = 4096, 256
#: First depth of reading, and its growth each round.
FIRST_DEPTH, DEEPER = 64, 4
#: Rounds of more than this share of a list are added as a matrix product of the entries read.
DENSE = 1 / 8
#: Survivors per wanted row at which reading stops and final scores are resolved.
RESOLVE = 8
EXACT = 2.0**53
SCHEMA = "query_id bigint, vec_id bigint, score bigint"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id`` and ``v``, the components as floor(scale * x) in doubles; unusable vectors left out."""
    def whole(e: Column) -> Column:
        y = F.lit(float(scale)) * e.cast("double")
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    x = F.transform(vec_col, whole)
    finite = F.forall(
        vec_col, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf")))
    )
    usable = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.coalesce(finite, F.lit(False))
    return df.where(usable).select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("v"))


def _resolve(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one integer-valued query with rows, exact."""
    if np.abs(q).max() * np.abs(x).max(initial=0) * len(q) < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(c) for c in q]
    scores = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in x]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in scores], dtype=np.int64)


class SortedLists:
    """The dimensions of a chunk of candidates as sorted lists."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0)
        self.values = np.take_along_axis(vectors, self.order, axis=0)  # column d is the list of dimension d
        self.least, self.most = self.values[0], self.values[-1]
        self.place = np.empty_like(self.order)
        np.put_along_axis(self.place, self.order, np.arange(len(vectors))[:, None], axis=0)
        #: Entries read, over all queries.
        self.read = 0

    def add(self, lower: np.ndarray, plus: np.ndarray, minus: np.ndarray, start: int, end: int) -> None:
        """Read all lists from one depth to the next, from the top for ``plus`` and the bottom for ``minus``."""
        n, dims = self.vectors.shape
        self.read += (end - start) * dims * lower.shape[1]
        if end - start > DENSE * n:
            top = (self.place >= n - end) & (self.place < n - start)
            bottom = (self.place >= start) & (self.place < end)
            lower += (self.vectors - self.least) * top @ plus
            lower += (self.vectors - self.most) * bottom @ minus
            return
        for d in range(dims):
            top, bottom = slice(n - end, n - start), slice(start, end)
            if plus[d].any():
                lower[self.order[top, d]] += (self.values[top, d] - self.least[d])[:, None] * plus[d]
            if minus[d].any():
                lower[self.order[bottom, d]] += (self.values[bottom, d] - self.most[d])[:, None] * minus[d]


def top_of_chunk(
    queries: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray, lists: SortedLists | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) in a chunk that can still be among its k best.

    ``floor`` holds the k-th score each query has reached before; nothing below it needs reading.
    """
    n, result = len(ids), [(ids[:0], np.empty(0, np.int64))] * len(queries)
    # lower bounds and what is added to them stay below four times the largest score
    if 4 * max(np.abs(queries).max(), 1.0) * max(np.abs(vectors).max(), 1.0) * vectors.shape[1] >= EXACT:
        for j, q in enumerate(queries):
            other = ids != own[j]
            result[j] = ids[other], _resolve(q, vectors[other])
        return result
    lists = lists or SortedLists(vectors)
    plus, minus = np.maximum(queries, 0).T, np.minimum(queries, 0).T
    todo = np.flatnonzero(lists.most @ plus + lists.least @ minus >= floor)
    plus, minus, kth = plus[:, todo], minus[:, todo], floor[todo].astype(float)
    mine = ids[:, None] == own[todo]
    lower = np.tile(lists.least @ plus + lists.most @ minus, (n, 1))
    lower[mine] = -np.inf
    before, depth = 0, min(FIRST_DEPTH, n)
    while len(todo):
        lists.add(lower, plus, minus, before, depth)
        if n > k:
            kth = np.maximum(kth, np.partition(lower, n - k, axis=0)[n - k])
        high, low = lists.values[n - depth], lists.values[depth - 1]
        unseen = high @ plus + low @ minus
        done = np.full(len(todo), depth == n)
        at = np.flatnonzero(done | (unseen < kth))
        alive = lower[:, at]
        if depth < n and len(at):
            alive = alive + ((high - lists.least) * (lists.place < n - depth)) @ plus[:, at]
            alive += ((low - lists.most) * (lists.place >= depth)) @ minus[:, at]
        alive = (alive >= kth[at]) & ~mine[:, at]
        for column, j in enumerate(at):
            rows = np.flatnonzero(alive[:, column])
            if depth == n:
                result[todo[j]] = ids[rows], lower[rows, j].astype(np.int64)
            elif len(rows) <= RESOLVE * k:
                result[todo[j]] = ids[rows], _resolve(queries[todo[j]], vectors[rows])
                done[j] = True
        go = ~done
        if not go.all():
            todo, kth, plus, minus, mine, lower = todo[go], kth[go], plus[:, go], minus[:, go], mine[:, go], lower[:, go]
        before, depth = depth, min(DEEPER * depth, n)
    return result


class _Best:
    """The k best of each query so far in a task."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k = own, k
        self.ids = [np.empty(0, np.int64)] * len(own)
        self.scores = [np.empty(0, np.int64)] * len(own)
        self.floor = np.full(len(own), -np.inf)

    def add(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[j], ids]), np.concatenate([self.scores[j], scores])
        best = np.lexsort((ids, ~scores))[: self.k]  # by falling score, then id
        self.ids[j], self.scores[j] = ids[best], scores[best]
        if len(best) == self.k:
            self.floor[j] = self.scores[j][-1]


def _search(block: list[tuple[int, list[float]]], k: int):
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in {len(v) for _, v in block}:
        rows = [(i, v) for i, v in block if len(v) == length]
        by_length[length] = np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {length: _Best(ids, k) for length, (ids, _) in by_length.items()}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            lengths = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for length, (own, queries) in by_length.items():
                rows = np.flatnonzero(lengths == length)
                for a in range(0, len(rows), CHUNK):
                    part = rows[a : a + CHUNK]
                    x = flat[starts[part][:, None] + np.arange(length)]
                    lists = SortedLists(x) if len(part) else None
                    for b in range(0, len(own), QUERIES):
                        cut = slice(b, b + QUERIES)
                        found = top_of_chunk(queries[cut], own[cut], ids[part], x, k, best[length].floor[cut], lists)
                        for j, (i, s) in enumerate(found):
                            best[length].add(b + j, i, s)
        for length, (own, _) in by_length.items():
            kept = best[length]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(own, [len(i) for i in kept.ids]), pa.int64()),
                    pa.array(np.concatenate([*kept.ids, np.empty(0, np.int64)]), pa.int64()),
                    pa.array(np.concatenate([*kept.scores, np.empty(0, np.int64)]), pa.int64()),
                ],
                names=["query_id", "vec_id", "score"],
            )

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    scale: int = SCALE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest scores of each query over all other rows.

    ``is_query`` is a predicate over ``vec_id``.
    """
    if k < 1:
        raise ValueError("k must be positive")
    candidates = integer_vectors(vectors, id_col, vec_col, scale)
    queries = candidates.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    found: list[DataFrame] = []
    for block in query_blocks(queries, F.col("vec_id"), F.size("v") * 8, block_bytes):
        if found:  # the driver holds one block at a time
            found[-1] = written(found[-1], "topk_block")
        rows = [(r["vec_id"], r["v"]) for r in block.collect()]
        found.append(candidates.mapInArrow(_search(rows, k), SCHEMA))
    result = reduce(DataFrame.unionByName, found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = result.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
