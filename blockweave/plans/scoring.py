"""Scores, probabilities, classes and accuracy of a fitted classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.functions import arrow, kernels
from blockweave.plans import network
from blockweave.session import BROADCAST_BYTES

_RESULT = "rawPrediction array<double>, probability array<double>, prediction double"


def _inputs(rows: pa.Array, width: int) -> np.ndarray:
    x = arrow.to_matrix(rows) if len(rows) else np.empty((0, width))
    if x.shape[1] != width:
        raise ValueError(f"expected {width} features but got {x.shape[1]}")
    return x


def _array_column(df: DataFrame, features: str):
    column = F.col(features)
    return vector_to_array(column) if isinstance(df.schema[features].dataType, VectorUDT) else column


def add_scores(
    df: DataFrame, weights: np.ndarray, layers: list[int], features: str = "features"
) -> DataFrame:
    """Add ``rawPrediction``, ``probability`` and ``prediction`` from a vector or array column.

    Only the feature column goes to Python, a batch at a time; all other columns stay in the JVM.
    """
    if weights.nbytes > BROADCAST_BYTES:
        raise ValueError("the weights exceed the broadcast limit; use score_relational")
    shared = df.sparkSession.sparkContext.broadcast(weights)
    layers = list(layers)

    @F.arrow_udf(_RESULT)
    def score(rows: pa.Array) -> pa.Array:
        raw = kernels.forward(shared.value, layers, _inputs(rows, layers[0]))[-1]
        if len(raw):
            probability = kernels.softmax(raw)[0]
            best = raw.argmax(axis=1).astype(np.float64)
        else:
            probability, best = raw, np.empty(0)
        return pa.StructArray.from_arrays(
            [arrow.to_lists(raw), arrow.to_lists(probability), pa.array(best)],
            ["rawPrediction", "probability", "prediction"],
        )

    return df.withColumn("_score", score(_array_column(df, features))).select(*df.columns, "_score.*")


def add_prediction(
    df: DataFrame, weights: np.ndarray, layers: list[int], features: str = "features"
) -> DataFrame:
    """Add the predicted class as ``prediction``; one double a row comes back from Python."""
    if weights.nbytes > BROADCAST_BYTES:
        raise ValueError("the weights exceed the broadcast limit; use score_relational")
    shared = df.sparkSession.sparkContext.broadcast(weights)
    layers = list(layers)

    @F.arrow_udf("double")
    def predict(rows: pa.Array) -> pa.Array:
        raw = kernels.forward(shared.value, layers, _inputs(rows, layers[0]))[-1]
        return pa.array(raw.argmax(axis=1).astype(np.float64) if len(raw) else np.empty(0))

    return df.withColumn("prediction", predict(_array_column(df, features)))


def score_relational(
    samples: DataFrame, weights: DataFrame, layers: list[int], key: str, features: str = "features"
) -> DataFrame:
    """``(i, prediction)`` by joins, for weights too large to broadcast."""
    inputs = network.feature_entries(samples, key, features, layers[0])
    return network.argmax_class(network.forward(inputs, weights, layers)[-1])


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """One row ``(n, accuracy)``."""
    hit = (F.col(prediction) == F.col(label).cast("double")).cast("double")
    return df.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))
