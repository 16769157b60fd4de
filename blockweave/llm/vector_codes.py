"""Codes of integer vectors by exact products: limbs in float64 BLAS, sums in int64, the first nearest entry.

A vector's components become integers floor(scale * x) and the vector is cut into equal consecutive parts. Each part
position has a codebook that starts as the part of the smallest ids' vectors. A round assigns every part to its nearest
entry and replaces the entries by the floored means of their parts.

Nearest entries come from |c|**2 - 2 x.c. The products are matrix products of limbs: integers are cut into
signed limbs of so few bits that a whole dot product of limbs stays below 2**53, where float64 is exact, and the products
of limbs are shifted and added in int64. How many limbs are needed follows from the largest component of the table.
Where sums could pass 64 bits, they are added in Python integers instead (same code, other dtype). The first of
equally near entries wins.

The integers are written once. A round is one pass over them: tasks send sums and counts of their entries, which Spark
adds up by entry; only the codebooks, whose size does not depend on the number of rows, come to the driver.

Defined results: rows whose vector is null or holds a null or non-finite component are left out. A shorter vector than
the longest is filled up with zeros, and all of them to a multiple of the number of parts. Codebooks take the rows first in order of
id (null last), then vector; repeated rows are rows like others. Fewer rows than entries give as many entries. Errors
are clipped at the largest long. Components beyond the doubles are clipped there. An empty table gives no rows.
Only the three named columns are read; a missing label column counts as null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import written
from blockweave.session import BROADCAST_BYTES

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Whole numbers below this are exact in float64.
EXACT_BITS = 53
#: Integers below this stay in int64.
WIDE = 1 << 62
#: Bits of a limb of a sum over many rows.
SUM_BITS = 30
#: Distances a task holds at once.
CELLS = 1 << 21
LONG = (1 << 63) - 1


def limb_bits(width: int) -> int:
    """Bits of a limb, so that a dot product of ``width`` limbs stays below 2**53."""
    return max(1, (EXACT_BITS - math.ceil(math.log2(max(width, 1)))) // 2)


def limbs(x: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """Signed limbs of whole numbers, lowest first: x = sum of limb k * 2**(bits * k). Float64 or Python integers."""
    if x.dtype == object:
        sign, rest = np.where(x < 0, -1, 1), np.abs(x)
        mask = (1 << bits) - 1
        return [((rest >> bits * k & mask) * sign).astype(np.float64) for k in range(count)]
    rest, found = x.astype(np.float64), []
    for k in reversed(range(count)):
        high = np.trunc(np.ldexp(rest, -bits * k))
        rest = rest - np.ldexp(high, bits * k)
        found.append(high)
    return found[::-1]


def limb_count(largest: int, bits: int) -> int:
    return max(1, -(-largest.bit_length() // bits))


def combine(products: np.ndarray, shift: int, wide: bool) -> np.ndarray:
    """Exact float64 products as integers, shifted: int64, or Python integers where 64 bits could be too few."""
    whole = products.astype(np.int64)
    return whole.astype(object) * (1 << shift) if wide else whole << shift


def dot_products(x: list[np.ndarray], y: list[np.ndarray], bits: int, wide: bool) -> np.ndarray:
    """All inner products of rows given by limbs, rows of ``x`` by rows of ``y``."""
    total = None
    for a, left in enumerate(x):
        for b, right in enumerate(y):
            term = combine(left @ right.T, bits * (a + b), wide)
            total = term if total is None else total + term
    return total


def squares(x: list[np.ndarray], bits: int, wide: bool) -> np.ndarray:
    """Inner product of every row with itself."""
    total = 0
    for a, left in enumerate(x):
        for b, right in enumerate(x):
            total = total + combine(np.einsum("ij,ij->i", left, right), bits * (a + b), wide)
    return total


@dataclass(frozen=True)
class Shape:
    """What a table fixes: components of a part, rows, and the largest component without its sign."""

    width: int
    rows: int
    largest: int

    @property
    def wide(self) -> bool:
        """Whether squared distances or sums over all rows may need more than 64 bits."""
        return max(4 * max(self.width, 1) * self.largest**2, self.rows * self.largest) >= WIDE


def nearest(parts: np.ndarray, codebook: np.ndarray, shape: Shape, bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first nearest entry, squared distance to it) of every row of ``parts``."""
    bits = bits or limb_bits(shape.width)
    count = limb_count(shape.largest, bits)
    entries = limbs(codebook, bits, count)
    norms = squares(entries, bits, shape.wide)
    codes, errors = [], []
    step = max(1, CELLS // max(len(codebook), 1))
    for start in range(0, len(parts), step):
        rows = limbs(parts[start : start + step], bits, count)
        apart = norms[None, :] - 2 * dot_products(rows, entries, bits, shape.wide)
        code = np.argmin(apart, axis=1)  # the first one on a tie
        codes.append(code)
        errors.append(squares(rows, bits, shape.wide) + apart[np.arange(len(code)), code])
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(codes), np.concatenate(errors)


def integer_rows(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """``vec_id, label, v`` (doubles, as bytes), ``n`` components, ``most``: the largest without sign. Written."""
    label = F.col(label_col) if label_col in df.columns else F.lit(None)
    usable = F.forall(vec_col, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = df.where(F.col(vec_col).isNotNull() & usable).select(
        F.col(id_col).cast("bigint").alias("vec_id"), label.cast("string").alias("label"),
        F.col(vec_col).cast("array<double>").alias("x"),
    )
    end = np.finfo(np.float64).max

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            with np.errstate(over="ignore"):
                flat = np.clip(np.floor(lists.flatten().to_numpy() * float(scale)), -end, end) + 0.0  # no -0.0
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            cuts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([c.astype("<f8").tobytes() for c in cuts], pa.binary()),
                    pa.array([len(c) for c in cuts], pa.int32()),
                    pa.array([float(np.abs(c).max(initial=0)) for c in cuts], pa.float64()),
                ],
                names=["vec_id", "label", "v", "n", "most"],
            )

    return written(rows.mapInArrow(whole, "vec_id bigint, label string, v binary, n int, most double"), "integer-vectors")


def to_parts(vectors: pa.Array, shape: Shape, parts: int) -> np.ndarray:
    """parts x rows x width components, filled up with zeros."""
    length = 8 * parts * shape.width
    sizes = pc.binary_length(vectors).to_numpy()
    cells = vectors.to_pylist()
    if len(sizes) and (sizes != length).any():
        cells = [c.ljust(length, b"\0") for c in cells]
    flat = np.frombuffer(b"".join(cells), "<f8")
    return flat.reshape(len(cells), parts, shape.width).transpose(1, 0, 2)


def _slices(batches: Iterator[pa.RecordBatch], shape: Shape, parts: int) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size, whatever the vectors' length is."""
    step = max(1, CELLS // max(1, shape.width * parts))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _sum_limbs(shape: Shape) -> int:
    return limb_count(shape.largest, SUM_BITS) if shape.wide else 1


def _sums(codebooks: list[np.ndarray], shape: Shape):
    """A task's sums: one row for every entry that it used."""
    parts, entries = len(codebooks), len(codebooks[0])
    count = _sum_limbs(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, count, shape.width), np.int64)
        used = np.zeros((parts, entries), np.int64)
        for batch in _slices(batches, shape, parts):
            for p, rows in enumerate(to_parts(batch.column(0), shape, parts)):
                codes, _ = nearest(rows, codebooks[p], shape)
                used[p] += np.bincount(codes, minlength=entries)
                order = np.argsort(codes, kind="stable")
                first = np.flatnonzero(np.diff(codes[order], prepend=-1))
                for k, limb in enumerate(limbs(rows, SUM_BITS, count) if count > 1 else [rows]):
                    whole = limb[order].astype(np.int64)
                    total[p, codes[order][first], k] += np.add.reduceat(whole, first, axis=0)
        p, e = np.nonzero(used)
        flat = total[p, e].reshape(len(p), -1)
        sums = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(used[p, e]), sums],
            names=["part", "entry", "used", "sums"],
        )

    return run


def _as_integers(values, wide: bool) -> np.ndarray:
    return np.array([int(v) for v in values], object if wide else np.int64)


def first_codebooks(rows: DataFrame, shape: Shape, parts: int, entries: int) -> list[np.ndarray]:
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    return [_as_integers(p.reshape(-1), shape.wide).reshape(p.shape) for p in to_parts(first, shape, parts)]


def next_codebooks(rows: DataFrame, codebooks: list[np.ndarray], shape: Shape) -> list[np.ndarray]:
    """Entries replaced by the floored means of the parts assigned to them; unused ones stay."""
    count, width = _sum_limbs(shape), shape.width
    sent = rows.select("v").mapInArrow(_sums(codebooks, shape), "part int, entry int, used bigint, sums array<bigint>")
    cells = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(count * width)]
    added = sent.groupBy("part", "entry").agg(F.sum("used").alias("used"), *cells).collect()
    fresh = [c.copy() for c in codebooks]
    for row in added:
        sums = np.array(row[3:], object).reshape(count, width)
        total = [sum(int(limb) << SUM_BITS * k for k, limb in enumerate(column)) for column in sums.T]
        fresh[row["part"]][row["entry"]] = [t // row["used"] for t in total]
    return fresh


def encode(rows: DataFrame, codebooks: list[np.ndarray], shape: Shape) -> DataFrame:
    """``vec_id, label, code, error`` of every row."""
    parts = len(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, shape, parts):
            codes, total = [], 0
            for p, part in enumerate(to_parts(batch.column(2), shape, parts)):
                code, error = nearest(part, codebooks[p], shape)
                codes.append(code.astype(np.uint8 if len(codebooks[p]) <= 256 else ">u2"))
                total = total + (error.astype(object) if shape.wide else error)
            digits = [row.tobytes().hex() for row in np.ascontiguousarray(np.stack(codes, axis=1))]
            error = pa.array([min(int(e), LONG) for e in total], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digits, pa.string()), error],
                names=["vec_id", "label", "code", "error"],
            )

    return rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id bigint, label string, code string, error bigint")


def fit_codebooks(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[list[np.ndarray], Shape]:
    """Codebooks after ``rounds`` passes over integer rows, one entries x width array a part."""
    facts = rows.agg(F.count("*"), F.max("n"), F.max("most")).first()
    shape = Shape(max(1, -(-(facts[1] or 0) // parts)), facts[0], int(facts[2] or 0))
    if not shape.rows:
        return [], shape
    codebooks = first_codebooks(rows, shape, parts, entries)
    for _ in range(rounds):
        codebooks = next_codebooks(rows, codebooks, shape)
    return codebooks, shape


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    numbers = ",".join(str(int(v)) for c in codebooks for v in c.reshape(-1))
    return hashlib.sha256(numbers.encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector."""
    if min(parts, entries, scale) < 1 or entries > 1 << 16 or rounds < 0:
        raise ValueError("parts, entries and scale must be positive, entries at most 65536, rounds not negative")
    rows = integer_rows(vectors, id_col, vec_col, label_col, scale)
    codebooks, shape = fit_codebooks(rows, parts, entries, rounds)
    if not shape.rows:
        return rows.selectExpr("vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    coded = written(encode(rows, codebooks, shape), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("bigint")
    labels = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    if labels.count() * 64 <= BROADCAST_BYTES:
        labels = F.broadcast(labels)
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256")
    )
