"""How well a classified table agrees with its labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(classified: DataFrame, label: str = "label", predicted: str = "class") -> DataFrame:
    """``(label, class, rows)``."""
    return classified.groupBy(
        F.col(label).cast("int").alias("label"), F.col(predicted).alias("class")
    ).agg(F.count(F.lit(1)).alias("rows"))


def accuracy(classified: DataFrame, label: str = "label", predicted: str = "class") -> DataFrame:
    """``(hits, rows, accuracy)`` in one row."""
    hit = F.sum((F.col(label) == F.col(predicted)).cast("bigint"))
    rows = F.count(F.lit(1))
    return classified.agg(
        hit.alias("hits"), rows.alias("rows"), (hit / rows).alias("accuracy")
    )
