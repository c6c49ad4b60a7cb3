"""Sequence files, labelled tables and sequence streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_sequences(spark: SparkSession, path: str, label: int | None = None) -> DataFrame:
    """One sequence per line as ``seq``, empty lines too; with ``label``, a constant column beside it."""
    rows = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("seq"))
    return rows if label is None else rows.withColumn("label", F.lit(label))


def read_labelled_sequences(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    """``(seq, label)`` from a file of positives and a file of negatives."""
    return read_sequences(spark, positive, 1).unionByName(read_sequences(spark, negative, 0))


def read_instances(spark: SparkSession, path: str, label: str = "label", features: str = "features") -> DataFrame:
    """Labelled instances from parquet, without the columns training does not use."""
    return spark.read.parquet(path).select(label, features)


def csv_schema(spark: SparkSession, path: str) -> StructType:
    """Column names and types of a CSV folder with header lines, from a static read."""
    return spark.read.csv(path, header=True, inferSchema=True).schema


def stream_csv(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A CSV folder or glob as a stream that takes in a few files at a time."""
    return (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(path)
    )


def stream_parquet(spark: SparkSession, folder: str, schema: StructType, file_pattern: str = "*.parquet") -> DataFrame:
    """The parquet files of a folder that match a pattern, as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", file_pattern).parquet(folder)
    )
