"""Tall matrices in factor form: a DataFrame ``(id bigint, f array<double>)``, one row per user or item.

All sums over factor rows are partly aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.functions import arrow
from blockweave.functions.columns import hash_uniform
from blockweave.operators.reduce import SCHEMA, partial_rows, tree_sum
from blockweave.session import shuffle_partitions

#: Up to this rank FᵀF is a generated aggregate, above it numpy on Arrow batches.
SMALL_RANK = 12
#: Vector elements summed in one generated aggregate; longer vectors are cut into pieces.
CHUNK = 32


def random_factor(
    ids: DataFrame, rank: int, seed: int, uniform: Callable[..., Column] = hash_uniform, keep: str | None = None
) -> DataFrame:
    """A row of ``rank`` uniform values in [0, 1) for every ``id``; the same at every recompute.

    ``uniform`` is an expression of the place and the seed, by default a hash. The column ``keep`` stays too.
    """
    values = F.transform(
        F.sequence(F.lit(0), F.lit(rank - 1)), lambda k: uniform(F.col("id"), k, seed=seed)
    )
    return ids.select(F.col("id").cast("bigint").alias("id"), values.alias("f"), *([keep] if keep else []))


def index_range(df: DataFrame, size: int) -> DataFrame:
    """All positions ``id`` from 0 to size - 1."""
    return df.sparkSession.range(size)


def to_entries(factor: DataFrame) -> DataFrame:
    """Factor rows as entries ``(i = id, j = k, v)``."""
    return factor.select(F.col("id").alias("i"), F.posexplode("f").alias("k", "v")).select(
        "i", F.col("k").cast("bigint").alias("j"), "v"
    )


def from_entries(entries: DataFrame, rank: int) -> DataFrame:
    """Entries ``(i, j, v)`` as factor rows; absent cells become zero, a j outside [0, rank) stops the job."""
    inside = (F.col("j") >= 0) & (F.col("j") < rank)
    message = F.concat(F.lit(f"column outside [0, {rank}): "), F.coalesce(F.col("j").cast("string"), F.lit("null")))
    checked = entries.withColumn("j", F.when(inside, F.col("j")).otherwise(F.raise_error(message).cast("bigint")))
    pieces = checked.select(
        F.col("i").alias("id"),
        F.expr(f"cast(j div {CHUNK} as int)").alias("piece"),
        (F.col("j") % CHUNK).alias("k"),
        "v",
    )
    sums = [
        F.expr(f"coalesce(sum(v) filter (where k = {k}), 0D) as s{k}") for k in range(min(CHUNK, rank))
    ]
    return _gather(pieces.groupBy("id", "piece").agg(*sums), rank)


def _gather(sums: DataFrame, rank: int) -> DataFrame:
    """Rows ``(id, piece, s0, s1, ...)`` as one array of length ``rank`` per id."""
    width = min(CHUNK, rank)
    values = F.expr("array(" + ", ".join(f"s{k}" for k in range(width)) + ")")
    if rank <= CHUNK:
        return sums.select("id", values.alias("f"))
    count = -(-rank // CHUNK)
    listed = (
        sums.select("id", "piece", values.alias("vs"))
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(F.struct("piece", "vs"))).alias("m"))
    )
    zeros = F.array_repeat(F.lit(0.0), width)
    whole = F.flatten(F.array(*[F.coalesce(F.col("m")[c], zeros) for c in range(count)]))
    return listed.select("id", F.slice(whole, 1, rank).alias("f"))


def _of_length(rank: int) -> Column:
    message = F.concat(F.lit(f"expected factor rows of {rank} values but got "), F.size("f").cast("string"))
    return F.when(F.size("f") == rank, F.col("f")).otherwise(F.raise_error(message).cast("array<double>"))


def weighted_sums(rows: DataFrame, rank: int) -> DataFrame:
    """Σ v·f per ``id`` of rows ``(id, v, f)``, as factor rows; a row of another length stops the job."""
    rows = rows.withColumn("f", _of_length(rank))
    if rank <= CHUNK:
        pieces = rows.withColumn("piece", F.lit(0))
    else:
        cuts = F.array(*[F.slice("f", start + 1, CHUNK) for start in range(0, rank, CHUNK)])
        pieces = rows.select("id", "v", F.posexplode(cuts).alias("piece", "f"))
    # get() yields null past the end of the last piece, which sum() leaves out.
    sums = [
        F.expr(f"coalesce(sum(get(f, {k}) * v), 0D) as s{k}") for k in range(min(CHUNK, rank))
    ]
    keys = ["id"] if rank <= CHUNK else ["id", "piece"]
    return _gather(pieces.groupBy(*keys).agg(*sums), rank)


def gram(factor: DataFrame, rank: int) -> DataFrame:
    """FᵀF as one row ``(g array<double>)`` of rank² values, row after row."""
    if rank > SMALL_RANK:
        return factor.sparkSession.createDataFrame(
            pa.table({"g": arrow.to_lists(gram_matrix(factor, rank).reshape(1, -1))})
        )
    # Elements become plain columns first: array access inside every product makes long code.
    wide = factor.select(_of_length(rank).alias("f")).selectExpr(*[f"get(f, {k}) as f{k}" for k in range(rank)])
    pairs = [(a, b) for a in range(rank) for b in range(a, rank)]
    sums = ", ".join(f"sum(f{a} * f{b}) as g{a}_{b}" for a, b in pairs)
    cells = ", ".join(
        f"coalesce(s.g{min(a, b)}_{max(a, b)}, 0D)" for a in range(rank) for b in range(rank)
    )
    return wide.agg(F.expr(f"struct({sums}) as s")).selectExpr(f"array({cells}) as g")


def gram_matrix(factor: DataFrame, rank: int) -> np.ndarray:
    """FᵀF as a rank x rank matrix on the driver."""
    if rank <= SMALL_RANK:
        return np.array(gram(factor, rank).first()["g"]).reshape(rank, rank)

    def partial(batches):
        total = np.zeros((rank, rank))
        for batch in batches:
            rows = arrow.to_matrix(batch.column(0))
            if len(rows):
                total += rows.T @ rows
        yield partial_rows(total)

    partials = factor.select("f").mapInArrow(partial, SCHEMA)
    total = tree_sum(partials, shuffle_partitions(factor.sparkSession), rank * rank)
    return np.zeros((rank, rank)) if total is None else total.reshape(rank, rank)


def gram_entries(factor: DataFrame, rank: int) -> DataFrame:
    """FᵀF as entries ``(i, j, v)``."""
    return (
        gram(factor, rank)
        .select(F.posexplode("g").alias("pos", "v"))
        .select(
            F.expr(f"cast(pos div {rank} as bigint)").alias("i"),
            (F.col("pos") % rank).cast("bigint").alias("j"),
            "v",
        )
    )


def apply_gram(factor: DataFrame, g: np.ndarray) -> DataFrame:
    """F·G for a symmetric rank x rank matrix: ``(id, f)``."""

    @F.arrow_udf("array<double>")
    def product(f: pa.Array) -> pa.Array:
        return arrow.to_lists(arrow.to_matrix(f) @ g) if len(f) else f

    return factor.select("id", product("f").alias("f"))


def update(factor: DataFrame, projected: DataFrame, g: np.ndarray) -> DataFrame:
    """F ∘ X ⊘ (F·G) in one pass; an id without a projected row becomes a zero row.

    The rank x rank matrix travels with the task. Only the two vectors of a row go to Python.
    """
    x = projected.select("id", F.col("f").alias("x"))
    zeros = F.array_repeat(F.lit(0.0), len(g))
    joined = factor.join(x, "id", "left").select("id", "f", F.coalesce("x", zeros).alias("x"))

    @F.arrow_udf("array<double>")
    def ratio(f: pa.Array, x: pa.Array) -> pa.Array:
        if not len(f):
            return f
        rows = arrow.to_matrix(f)
        product = rows * arrow.to_matrix(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            return arrow.to_lists(np.where(product == 0, 0.0, product / (rows @ g)))

    return joined.select("id", ratio("f", "x").alias("f"))
