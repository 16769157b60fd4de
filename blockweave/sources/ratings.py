"""Rating files: CSV with a header, of which three named columns are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.operators.entry import to_entries


def read_ratings(
    spark: SparkSession,
    path: str,
    *,
    user: str = "userId",
    item: str = "movieId",
    rating: str = "rating",
    partitions: int | None = None,
) -> DataFrame:
    """``(userId bigint, movieId bigint, rating double)``; other columns are not parsed.

    A value that is empty or not a number stops the job.
    """

    def number(name: str, kind: str):
        empty = F.raise_error(F.lit(f"empty field in column {name}")).cast(kind)
        return F.when(F.col(name).isNotNull(), F.col(name).cast(kind)).otherwise(empty)

    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    picked = rows.select(
        number(user, "bigint").alias("userId"),
        number(item, "bigint").alias("movieId"),
        number(rating, "double").alias("rating"),
    )
    return picked.repartition(partitions) if partitions else picked


def rating_entries(ratings: DataFrame) -> DataFrame:
    """Ratings as matrix entries, ids taken as positions."""
    return to_entries(ratings, "userId", "movieId", "rating")


def write_ratings(entries: DataFrame, path: str, *, compression: str | None = None) -> None:
    """Entries as a rating file with a header."""
    writer = entries.select(
        F.col("i").alias("userId"), F.col("j").alias("movieId"), F.col("v").alias("rating")
    ).write.option("header", True)
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)
