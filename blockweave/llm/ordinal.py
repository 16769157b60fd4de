"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a set of hashed features: its words, runs of punctuation, and a few measures, a feature for each
step reached (share of capitals, of punctuation, of repeated words). One weight vector is shared by all grades; ordered thresholds
cut its score: P(grade >= k) = sigmoid(score - threshold_k). So a model gives every text an expected grade
and the probability of the top grade, by which texts are selected.

The fit maximises the likelihood with a quadratic penalty by L-BFGS. Gradients are sums over a table of
hashed training rows: each task returns one partial gradient. ``TRAIN_ROWS`` bounds the labelled sample;
it is drawn by a hash of the document id over all labels.

Grades here: 0 toxic, 1 poor, 2 good. A label that is null counts as 0 quality and 0 toxic.

Defined results: null or empty texts have no words and are scored from what is left; they get a row
like any other. Labels without a document, or without an id, are unused; of several labels of a document the
lowest grade counts. Without any labels every text scores alike and is kept. Repeated rows get the same
score. Only named columns are read, all columns of the documents are kept by ``select_good``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import release_memory, text_runs, written
from blockweave.llm.words import WordHashes

GRADES = 3
#: Bytes of text that a task hashes at once.
TEXT_BYTES = 4 << 20
FEATURES = 1 << 18
#: Most labelled rows used for a fit.
TRAIN_ROWS = 20_000
PENALTY, ITERATIONS, MEMORY = 0.5, 60, 8
#: Features of a smaller share of the training rows (or of one row) get no weight; the fit's vectors have a
#: number for each of the others.
LEAST_SHARE = 0.001
#: A text is kept when the probability of the top grade reaches this.
KEEP = 0.5
#: Tasks of a gradient sum; each returns one number a weight.
GRADIENT_TASKS = 8
TOKEN = re.compile(r"\w+|[^\w\s]+")
_STEPS = np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9])


def _measures(text: str, tokens: list[str]) -> list[str]:
    raw = np.frombuffer(text.encode("utf-8", "ignore"), np.uint8)
    size = max(1, len(raw))
    capitals = int(((raw >= 65) & (raw <= 90)).sum()) / size
    words = sum(t[0].isalnum() for t in tokens)
    marks = (len(tokens) - words) / max(1, len(tokens))
    repeated = 1 - len(set(tokens)) / max(1, len(tokens))
    shares = (("capitals", capitals), ("marks", marks), ("repeated", repeated))
    return [f"\0{name}{n}" for name, x in shares for n in range(int(np.searchsorted(_STEPS, x, "right")) + 1)]


def features(texts: list[str | None], hashes: WordHashes, size: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all texts one after another, features per text); each feature counts once a text."""
    rows = []
    mask = size - 1
    for text in texts:
        text = text or ""
        tokens = TOKEN.findall(text.lower())
        rows.append(np.fromiter({hashes[t] & mask for t in [*tokens, *_measures(text, tokens)]}, np.int32))
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return (np.concatenate(rows) if rows else np.empty(0, np.int32)), sizes


def scores(weights: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[flat])])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free parameters: the first, then logs of the gaps."""
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(free[1:], -30, 30)))])


def loss_and_gradient(
    params: np.ndarray, flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray
) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of some rows and its gradient by (weights, free threshold parameters)."""
    cuts = GRADES - 1
    weights, free = params[:-cuts], params[-cuts:]
    limits = thresholds(free)
    score = scores(weights, flat, sizes)
    inf = np.array([np.inf])
    lower, upper = np.concatenate([-inf, limits])[grades], np.concatenate([limits, inf])[grades]
    below, above = _sigmoid(upper - score), _sigmoid(lower - score)
    p = np.maximum(below - above, 1e-12)
    slope_up, slope_low = below * (1 - below) / p, above * (1 - above) / p
    by_score = slope_up - slope_low  # of the loss
    by_limit = np.zeros(cuts)
    np.add.at(by_limit, grades[grades < cuts], -slope_up[grades < cuts])
    np.add.at(by_limit, grades[grades > 0] - 1, slope_low[grades > 0])
    by_free = np.array([by_limit.sum(), *(np.exp(free[k]) * by_limit[k:].sum() for k in range(1, cuts))])
    by_weight = np.bincount(flat, np.repeat(by_score, sizes), len(weights))
    return float(-np.log(p).sum()), np.concatenate([by_weight, by_free])


def minimise(
    start: np.ndarray, f: Callable[[np.ndarray], tuple[float, np.ndarray]], iterations: int, memory: int = MEMORY
) -> np.ndarray:
    """L-BFGS with a backtracking step; stops when a step gains less than 1e-5 of the loss."""
    x, (loss, gradient) = start, f(start)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(iterations):
        direction, alphas = -gradient.copy(), []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * (s @ direction))
            direction -= alphas[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(1.0, float(np.abs(gradient).max()))
        for (s, y, rho), alpha in zip(pairs, reversed(alphas), strict=True):
            direction += (alpha - rho * (y @ direction)) * s
        slope, step = float(gradient @ direction), 1.0
        if slope >= 0:
            break
        for _ in range(20):
            next_loss, next_gradient = f(x + step * direction)
            if next_loss <= loss + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * direction, next_gradient - gradient
        if s @ y > 1e-10:
            pairs = [*pairs, (s, y, 1 / float(s @ y))][-memory:]
        gained = loss - next_loss
        x, loss, gradient = x + s, next_loss, next_gradient
        if gained < 1e-5 * max(1.0, abs(loss)):
            break
    return x


@dataclass
class OrdinalModel:
    weights: np.ndarray
    limits: np.ndarray

    def tails(self, texts: list[str | None], hashes: WordHashes) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1, a row each."""
        score = scores(self.weights, *features(texts, hashes, len(self.weights)))
        return _sigmoid(score[None, :] - self.limits[:, None])

    def tails_of(self, texts: pa.Array, hashes: WordHashes) -> np.ndarray:
        """The same for a batch, a bounded run of texts at once."""
        parts = [self.tails(texts[run].to_pylist(), hashes) for run in text_runs(texts, TEXT_BYTES)]
        return np.concatenate(parts, axis=1) if parts else np.empty((len(self.limits), 0))


def compact(flat: np.ndarray, sizes: np.ndarray, kept: np.ndarray, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features as numbers of ``kept`` ones, the others left out."""
    number = np.full(features, -1, np.int64)
    number[kept] = np.arange(len(kept))
    flat = number[flat]
    ends = np.cumsum(sizes)
    left = np.concatenate([[0], np.cumsum(flat >= 0)])
    return flat[flat >= 0], left[ends] - left[ends - sizes]


def training_rows(
    docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``idx array<int>, grade`` of at most ``rows`` labelled documents, hashed and written."""
    toxic, good = F.coalesce("toxic", F.lit(0)) > 0, F.coalesce("quality", F.lit(0)) > 0
    graded = labels.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("label_id"), F.when(toxic, 0).when(good, 2).otherwise(1).alias("grade")
    )
    one = graded.groupBy("label_id").agg(F.min("grade").alias("grade"))
    sample = one.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).cast("bigint").alias("label_id"), F.col(text_col).alias("text"))
    met = texts.join(F.broadcast(sample), "label_id").select("text", "grade")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in text_runs(batch.column(0), TEXT_BYTES):
                flat, sizes = features(batch.column(0)[part].to_pylist(), hashes)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat))
                yield pa.RecordBatch.from_arrays([lists, batch.column(1)[part]], names=["idx", "grade"])
        release_memory()

    return written(met.mapInArrow(hashed, "idx array<int>, grade int"), "ordinal-rows")


def fit(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, penalty: float = PENALTY,
    iterations: int = ITERATIONS, id_col: str = "doc_id", text_col: str = "text",
) -> OrdinalModel:
    """Fit on a bounded sample of labelled documents."""
    table = training_rows(docs, labels, train_rows, id_col, text_col).coalesce(GRADIENT_TASKS)
    counts = {r["grade"]: r["n"] for r in table.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    cuts = GRADES - 1
    if not total:
        return OrdinalModel(np.zeros(FEATURES), np.full(cuts, -30.0))
    below = np.cumsum([counts.get(g, 0) + 0.5 for g in range(cuts)]) / (total + GRADES * 0.5)
    limits = np.log(below / (1 - below))
    common = table.select(F.explode("idx").alias("f")).groupBy("f").count().where(F.col("count") >= max(2.0, LEAST_SHARE * total))
    kept = np.sort(np.array([r["f"] for r in common.select("f").collect()], np.int64))  # FEATURES at most
    start = np.concatenate([np.zeros(len(kept)), limits[:1], np.log(np.maximum(np.diff(limits), 1e-3))])
    context = docs.sparkSession.sparkContext

    def whole(params: np.ndarray) -> tuple[float, np.ndarray]:
        shared, size = context.broadcast(params), len(params)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, gradient = 0.0, np.zeros(size)
            for batch in batches:
                lists = batch.column(0)
                some = compact(lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), kept)
                part = loss_and_gradient(shared.value, *some, batch.column(1).to_numpy())
                loss, gradient = loss + part[0], gradient + part[1]
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.tobytes()])], names=["loss", "gradient"])

        parts = table.mapInArrow(partial, "loss double, gradient binary").collect()
        shared.destroy()
        weights = params[:-cuts]
        gradient = np.sum([np.frombuffer(r["gradient"]) for r in parts], axis=0)
        gradient[:-cuts] += penalty * weights
        return sum(r["loss"] for r in parts) + 0.5 * penalty * float(weights @ weights), gradient

    found = minimise(start, whole, iterations)
    weights = np.zeros(FEATURES, np.float32)
    weights[kept] = found[:-cuts]
    return OrdinalModel(weights, thresholds(found[-cuts:]))


def grade(docs: DataFrame, model: OrdinalModel, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, p_top, keep`` of every document; the model (one megabyte) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            tails = shared.value.tails_of(batch.column(1), hashes)
            columns = [batch.column(0), pa.array(tails.sum(axis=0)), pa.array(tails[-1]), pa.array(tails[-1] >= keep)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "expected_grade", "p_top", "keep"])
        release_memory()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, expected_grade double, p_top double, keep boolean")


def select_good(docs: DataFrame, model: OrdinalModel, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns; one pass, no shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep_good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield batch.filter(pa.array(shared.value.tails_of(batch.column(at), hashes)[-1] >= keep))
        release_memory()

    return docs.mapInArrow(keep_good, docs.schema)
