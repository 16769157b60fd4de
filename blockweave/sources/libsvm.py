"""Labelled samples in libsvm text files."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.functions.columns import one_hot


def read_libsvm(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """``(label double, features vector)``; give the number of features to save a pass over the file."""
    reader = spark.read.format("libsvm")
    if features is not None:
        reader = reader.option("numFeatures", str(features))
    return reader.load(path)


def write_libsvm(samples: DataFrame, path: str, features: str = "features", label: str = "label") -> None:
    column = F.col(features)
    if not isinstance(samples.schema[features].dataType, VectorUDT):
        column = array_to_vector(column.cast("array<double>"))
    samples.select(F.col(label).cast("double").alias("label"), column.alias("features")).write.format(
        "libsvm"
    ).save(path)


def dense(samples: DataFrame, features: str = "features") -> Column:
    """The feature column as ``array<double>``, whether it holds arrays or vectors."""
    if isinstance(samples.schema[features].dataType, VectorUDT):
        return vector_to_array(features)
    return F.col(features).cast("array<double>")


def training_pairs(
    samples: DataFrame, classes: int, features: str = "features", label: str = "label"
) -> DataFrame:
    """``(features array<double>, target array<double>)`` with one-hot targets."""
    return samples.select(
        dense(samples, features).alias("features"), one_hot(F.col(label), classes).alias("target")
    )
