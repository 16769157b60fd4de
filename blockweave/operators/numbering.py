"""Dense numbers 0, 1, 2, ... for the ids that occur, without a task or driver that sees all of them.

Rows are dealt over ranges of their order, sorted inside each range and written; a row's number is its place in its range
plus the rows of earlier ranges. Only one count a range leaves the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.session import cut

#: Bits below the partition number in ``monotonically_increasing_id``.
PLACE_BITS = 33


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """``df`` and each row's place (bigint, from 0) in the given order; rows that are equal in it are in any order."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # written, so that the places of rows and the counts below are of the same ranges
    placed = cut(dealt.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, PLACE_BITS)
    counts = placed.groupBy(part.alias("part_no")).agg(F.count("*").alias("part_rows"))
    earlier = Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = counts.select("part_no", F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("part_start"))
    place = F.col("part_start") + F.col(name).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    met = placed.join(F.broadcast(starts), part == F.col("part_no"))
    return met.select(*[c for c in df.columns if c != name], place.alias(name))


def number_ids(df: DataFrame, column: str) -> DataFrame:
    """``id, number``: every id of ``column`` once, numbered in ascending order; null is no id."""
    ids = df.select(F.col(column).alias("id")).where("id is not null").distinct()
    return numbered(ids, "id")


def to_numbers(df: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
    """``df`` with the ids of ``column`` replaced by their numbers; rows whose id has none are left out."""
    return _replaced(df, column, numbers.select(F.col("id").alias("key_from"), F.col("number").alias("key_to")))


def to_ids(df: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
    """The way back: numbers of ``column`` replaced by ids."""
    return _replaced(df, column, numbers.select(F.col("number").alias("key_from"), F.col("id").alias("key_to")))


def _replaced(df: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    met = df.join(pairs, df[column] == pairs["key_from"])
    return met.select(*[F.col("key_to").alias(c) if c == column else df[c] for c in df.columns])
