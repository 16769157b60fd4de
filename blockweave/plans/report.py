"""Small result tables of a fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.operators import entry
from blockweave.plans.nmf import Factors
from blockweave.plans.scoring import accuracy
from blockweave.plans.training import MlpModel


def fit_summary(ratings: DataFrame, fitted: Factors, block_rows: int, block_cols: int) -> DataFrame:
    """Sizes of A, W and H: one row per matrix."""
    cells = entry.matrix_profile(entry.sum_duplicates(ratings), block_rows, block_cols)
    tables = [cells.select(F.lit("A").alias("matrix"), "*")]
    # Factor rows are counted as they are, not taken apart.
    ids = F.coalesce(F.max("id") + 1, F.lit(0)).cast("bigint")
    stored = F.coalesce(F.sum(F.size("f")), F.lit(0)).cast("bigint").alias("stored")
    for name, rows, sides in (("W", fitted.w, ("rows", "cols")), ("H", fitted.h, ("cols", "rows"))):
        size = rows.agg(ids.alias(sides[0]), stored).withColumn(
            sides[1], F.when(F.col(sides[0]) > 0, fitted.rank).otherwise(0).cast("bigint")
        )
        profile = entry.profile_of(size, block_rows, block_cols)
        tables.append(profile.select(F.lit(name).alias("matrix"), "*"))
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def loss_history(samples: DataFrame, model: MlpModel) -> DataFrame:
    """Loss per iteration: ``(iteration, loss_sum, n, mean_loss)``."""
    return model.loss_history(samples.sparkSession)


def train_accuracy(samples: DataFrame, model: MlpModel, label: str = "label") -> DataFrame:
    """Accuracy on the rows the model was trained with, named as such."""
    scored = accuracy(model.transform(samples), label=label)
    return scored.withColumnRenamed("accuracy", "train_accuracy")
