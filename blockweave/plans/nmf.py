"""Non-negative matrix factorisation A ≈ W·H by multiplicative updates.

    H ← H ∘ (WᵀA) ⊘ ((WᵀW)H)          W ← W ∘ (AHᵀ) ⊘ (W(HHᵀ))

A stays sparse. W and H are in factor form, one row per user and one per item, so both updates are
the same job with the roles of i and j exchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from blockweave.functions.columns import hash_uniform, vector_dot
from blockweave.operators import entry, factor, gram_tiles, numbering, tiled
from blockweave.session import BROADCAST_BYTES, cut, shuffle_partitions

#: A key with fewer cells than this is never treated as hot.
MIN_HOT_CELLS = 100_000
#: Cells for each partition of the tiles, unless the caller sets their number: fewer tiles copy fewer factor rows.
PARTITION_CELLS = 2_000_000


class Ratings:
    """A rating matrix prepared for factorisation: one entry per cell, in tiles of users and items.

    ``reuse`` keeps the tiles for later passes; without it they serve one update. ``unique``
    says that there is one entry per cell already and saves the shuffle that adds repeated ones. A rating
    without an id or value, or with a negative id, stops the job.
    """

    def __init__(
        self,
        entries: DataFrame,
        hot: int | None = None,
        partitions: int | None = None,
        reuse: bool = True,
        unique: bool = False,
    ):
        self._hot = hot
        self._reuse = reuse
        cells = entries.select("i", "j", "v") if unique else entry.sum_duplicates(entries)
        self.cells = cells.persist(StorageLevel.MEMORY_AND_DISK_DESER)
        self._tiled: tiled.TiledMatrix | None = None
        bad = F.col("i").isNull() | F.col("j").isNull() | F.col("v").isNull() | (F.col("i") < 0) | (F.col("j") < 0)
        facts = self.cells.agg(
            F.count("*"), F.max("i"), F.max("j"), F.coalesce(F.sum(F.when(bad, 1)), F.lit(0)),
            F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)),
        ).first()
        if facts[3]:
            self.release()
            raise ValueError(f"{facts[3]} ratings have a null or negative id, or no value")
        self.count = facts[0]
        # enough partitions for the cells and for all cores, and no more than the session's
        spark = entries.sparkSession
        wanted = max(-(-self.count // PARTITION_CELLS), 2 * spark.sparkContext.defaultParallelism)
        self._parts = partitions or min(wanted, shuffle_partitions(spark))
        #: ‖A‖², needed by every objective.
        self.square = facts[4]
        self.rows = 0 if facts[1] is None else facts[1] + 1
        self.cols = 0 if facts[2] is None else facts[2] + 1

    def _hot_keys(self, index: str, other_size: int) -> list[int]:
        """Ids with more than an even share of the cells; at most as many as partitions."""
        limit = self._hot
        if limit is None:
            limit = max(self.count // self._parts, MIN_HOT_CELLS)
        if other_size <= limit:
            # Cells are unique, so an id holds at most one for each index of the other side.
            return []
        counts = self.cells.groupBy(F.col(index).alias("key")).count().where(F.col("count") > limit)
        return [row["key"] for row in counts.orderBy(F.desc("count")).collect()]

    @property
    def tiled(self) -> tiled.TiledMatrix:
        """The one layout that both updates use; from here on the plain cells are not kept."""
        if self._tiled is None:
            hot = self._hot_keys("i", self.cols), self._hot_keys("j", self.rows)
            # an id range with gaps has no more ids than cells
            sides = min(self.rows, self.count), min(self.cols, self.count)
            tiling = tiled.choose_tiling(*sides, self.count, self._parts)
            self._tiled = tiled.TiledMatrix(self.cells, tiling, self._parts, *hot, reuse=self._reuse)
            if self._reuse:
                self.cells.unpersist()
        return self._tiled

    @property
    def by_row(self) -> tiled.Side:
        return self.tiled.by_row

    @property
    def by_col(self) -> tiled.Side:
        return self.tiled.by_col

    def release(self) -> None:
        self.cells.unpersist()
        if self._tiled is not None:
            self._tiled.release()


def update_h(ratings: Ratings, w: DataFrame, h: DataFrame, rank: int) -> DataFrame:
    """New H from A, W and H; one row per item."""
    return _updated(h, ratings.by_row.project(w, rank), w, rank)


def update_w(ratings: Ratings, w: DataFrame, h: DataFrame, rank: int) -> DataFrame:
    """New W from A, W and H; one row per user."""
    return _updated(w, ratings.by_col.project(h, rank), h, rank)


def _updated(rows: DataFrame, projected: DataFrame, other: DataFrame, rank: int) -> DataFrame:
    """The update of one factor; a Gram matrix above the broadcast limit stays a table."""
    if 8 * rank * rank > BROADCAST_BYTES:
        return gram_tiles.update(rows, projected, gram_tiles.gram_blocks(other, rank))
    return factor.update(rows, projected, factor.gram_matrix(other, rank))


def objective(ratings: Ratings, w: DataFrame, h: DataFrame, rank: int) -> float:
    """‖A − WH‖², from the parts ‖A‖² − 2·Σ h·(WᵀA) + Σ (WᵀW)∘(HHᵀ)."""
    x = ratings.by_row.project(w, rank).select("id", F.col("f").alias("x"))
    inner = vector_dot(F.col("f"), F.col("x"))
    cross = h.join(x, "id").agg(F.coalesce(F.sum(inner), F.lit(0.0))).first()[0]
    both = factor.gram_matrix(w, rank) * factor.gram_matrix(h, rank)
    return ratings.square - 2.0 * cross + float(both.sum())


@dataclass
class Factors:
    """A fitted factorisation."""

    w: DataFrame
    h: DataFrame
    rank: int
    rows: int
    cols: int
    objectives: list[float] = field(default_factory=list)


def _check_covered(cells: DataFrame, index: str, given: DataFrame) -> None:
    """Ratings whose id a supplied factor lacks would be lost in the joins."""
    ids = cells.select(F.col(index).alias("id")).distinct()
    missing = ids.join(given.select("id"), "id", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"a supplied factor has no row for {index} = {[r['id'] for r in missing]}")


class PassRecord:
    """Passes of a fit written to a shared folder, so that a stopped fit goes on from the last whole one.

    Two places are written by turns, the factors first and the record of the pass last; so one whole pass is always
    there, and no more than two. A record names the fit it belongs to, and another fit does not take it up.
    """

    SCHEMA = "iteration int, rank int, seed bigint, cells bigint, square double, rows bigint, cols bigint, ids string, objectives array<double>"

    def __init__(self, spark: SparkSession, folder: str, fit: dict):
        self.spark, self.folder, self.fit = spark, folder.rstrip("/"), fit

    def _place(self, iteration: int, what: str) -> str:
        return f"{self.folder}/place-{iteration % 2}/{what}"

    def save(self, iteration: int, w: DataFrame, h: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Write the factors of a pass; returns them as read back."""
        for name, rows in (("w", w), ("h", h)):
            rows.write.mode("overwrite").parquet(self._place(iteration, name))
        return self._factors(iteration)

    def finish(self, iteration: int, objectives: list[float]) -> None:
        """The record of a pass whose factors are written."""
        row = {**self.fit, "iteration": iteration, "objectives": [float(x) for x in objectives]}
        one = self.spark.createDataFrame([row], self.SCHEMA).coalesce(1)
        one.write.mode("overwrite").parquet(self._place(iteration, "record"))

    def _factors(self, iteration: int) -> tuple[DataFrame, DataFrame]:
        read = self.spark.read.schema("id bigint, f array<double>")
        return read.parquet(self._place(iteration, "w")), read.parquet(self._place(iteration, "h"))

    def last(self) -> tuple[int, DataFrame, DataFrame, list[float]] | None:
        """The last whole pass: iteration, factors and objectives."""
        found = []
        for place in (0, 1):
            try:
                found += self.spark.read.schema(self.SCHEMA).parquet(self._place(place, "record")).collect()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        if not found:
            return None
        record = max(found, key=lambda r: r["iteration"])
        for name, value in self.fit.items():
            same = math.isclose(record[name], value, rel_tol=1e-9) if isinstance(value, float) else record[name] == value
            if not same:
                raise ValueError(f"{self.folder} holds a fit with {name} = {record[name]}, not {value}")
        return (record["iteration"], *self._factors(record["iteration"]), list(record["objectives"]))


def start_factors(
    ratings: Ratings, rank: int, seed: int, ids: str, uniform: Callable[..., Column] = hash_uniform
) -> tuple[DataFrame, DataFrame]:
    """Random factors for every id up to the largest, or for the ids that occur by their number among them."""
    made = []
    for n, (index, size) in enumerate((("i", ratings.rows), ("j", ratings.cols))):
        if ids == "all":
            made.append(factor.random_factor(factor.index_range(ratings.cells, size), rank, seed + n, uniform))
        else:
            numbers = numbering.number_ids(ratings.cells, index)
            places = numbers.select(F.col("number").alias("id"), F.col("id").alias("own"))
            rows = factor.random_factor(places, rank, seed + n, uniform, keep="own")
            made.append(cut(rows.select(F.col("own").alias("id"), "f")))
    return made[0], made[1]


def fit(
    entries: DataFrame,
    rank: int,
    iterations: int,
    *,
    seed: int = 11,
    w: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    h: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    partitions: int | None = None,
    track_objective: bool = False,
    hot: int | None = None,
    unique: bool = False,
    ids: str = "all",
    record: str | None = None,
    uniform: Callable[..., Column] = hash_uniform,
) -> Factors:
    """Run a fixed number of passes, H first and then W with the new H.

    Each new factor is written to the shared checkpoint folder, so the plan of a pass never contains
    an earlier one and a lost executor costs at most that pass. ``ids="all"`` gives a row to every id from 0 to the
    largest, ``"occurring"`` only to those that have ratings, whatever numbers they are. With ``record``, a shared folder,
    every pass is written there and a fit that was stopped goes on behind its last whole pass; the factors
    returned are read from that folder. ``w`` and ``h`` are start factors, or functions that make them from all ids up to
    the largest rated one. ``uniform`` gives the start values from place, rank index and seed.
    """
    if rank < 1:
        raise ValueError("rank must be at least 1")
    if iterations < 0:
        raise ValueError("iterations must not be negative")
    if ids not in ("all", "occurring"):
        raise ValueError('ids must be "all" or "occurring"')
    ratings = Ratings(entries, hot, partitions, unique=unique)
    try:
        rows, cols = ratings.rows, ratings.cols
        for index, given in (("i", w), ("j", h)):
            if given is not None and not callable(given):
                _check_covered(ratings.cells, index, given)
        spark = entries.sparkSession
        w, h = (f(spark.range(size)) if callable(f) else f for f, size in ((w, rows), (h, cols)))
        own = {"rank": rank, "seed": seed, "cells": ratings.count, "square": float(ratings.square), "rows": rows, "cols": cols, "ids": ids}
        written = PassRecord(spark, record, own) if record else None
        before = written.last() if written else None
        if before:
            done, w, h, objectives = before
        else:
            done, objectives = 0, []
            if w is None or h is None:
                start = start_factors(ratings, rank, seed, ids, uniform)
                w, h = start[0] if w is None else w, start[1] if h is None else h
        result = Factors(w, h, rank, rows, cols, objectives)
        for iteration in range(done + 1, iterations + 1):
            result.h = cut(update_h(ratings, result.w, result.h, rank))
            result.w = cut(update_w(ratings, result.w, result.h, rank))
            if written:
                result.w, result.h = written.save(iteration, result.w, result.h)
            if track_objective:
                result.objectives.append(objective(ratings, result.w, result.h, rank))
            if written:
                written.finish(iteration, result.objectives)
        return result
    finally:
        ratings.release()
