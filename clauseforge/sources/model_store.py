"""Saved models: ``<path>.model``, ``<path>.metadata``, and ``<path>.manifest``, which is written last.

The manifest names the other two. Without it there is no model: a save that stopped
in between leaves nothing that loads. Text models that others wrote have no manifest;
they are read where both folders are complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.errors import IncompleteModelError
from clauseforge.storage import folder_names, is_complete

PARTS = ("model", "metadata")
METADATA_SCHEMA = (
    "version string, formula string, training_time double, "
    "training_pos bigint, training_neg bigint, width int, term_count int"
)


def write_tables(terms: DataFrame, metadata: DataFrame, path: str) -> None:
    terms.coalesce(1).write.mode("error").parquet(f"{path}.model")
    metadata.coalesce(1).write.mode("error").parquet(f"{path}.metadata")
    write_manifest(terms.sparkSession, path)


def write_manifest(spark: SparkSession, path: str) -> None:
    """The commit of a saved model."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    lines = spark.createDataFrame([("\n".join(f"{name}.{part}" for part in PARTS),)], "value string")
    lines.coalesce(1).write.mode("error").text(f"{path}.manifest")


def check_complete(spark: SparkSession, path: str, needs_manifest: bool = True) -> None:
    """An error unless a whole model lies under ``path``."""
    present = all(is_complete(spark, f"{path}.{part}") for part in PARTS)
    if folder_names(spark, f"{path}.manifest"):
        name = path.rstrip("/").rsplit("/", 1)[-1]
        named = is_complete(spark, f"{path}.manifest") and set(_lines(spark, f"{path}.manifest"))
        present = present and named == {f"{name}.{part}" for part in PARTS}
    elif needs_manifest:
        present = False
    if not present:
        raise IncompleteModelError(f"no complete model under {path}")


def read_tables(spark: SparkSession, path: str) -> dict:
    check_complete(spark, path)
    meta = spark.read.parquet(f"{path}.metadata").head()
    terms: list[dict[int, int]] = [{} for _ in range(meta["term_count"])]
    for row in spark.read.parquet(f"{path}.model").collect():  # one row per literal of the model
        terms[row["term_no"] - 1][row["feature"]] = row["want"]
    return {
        "terms": terms,
        "width": meta["width"],
        "version": meta["version"],
        "training_time": meta["training_time"],
        "training_pos": meta["training_pos"],
        "training_neg": meta["training_neg"],
    }


def write_lines(spark: SparkSession, path: str, model) -> None:
    """Text form: a line of n numbers per term, and five lines of metadata."""
    term_lines = [",".join(str(x) for x in values) for values in model.term_arrays]
    meta_lines = [
        model.version,
        model.formula,
        str(float(model.training_time)),
        str(model.training_pos),
        str(model.training_neg),
    ]
    for name, lines in (("model", term_lines), ("metadata", meta_lines)):
        # One row, so the order of the lines does not hang on partitioning.
        text = spark.createDataFrame([("\n".join(lines),)], "value string")
        text.coalesce(1).write.mode("error").text(f"{path}.{name}")
    write_manifest(spark, path)


def _lines(spark: SparkSession, path: str) -> list[str]:
    """Non-empty lines of a folder, whole files at a time so that order is kept."""
    files = (
        spark.read.text(path, wholetext=True)
        .select(F.input_file_name().alias("file"), "value")
        .orderBy("file")
        .collect()  # model-sized
    )
    return [line for f in files for line in f["value"].splitlines() if line]


def parse_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Comma-separated numbers to ``array<double>``."""
    return lines.select(F.split(F.col(column), ",").cast("array<double>").alias("features"))


def read_lines(spark: SparkSession, path: str) -> dict:
    check_complete(spark, path, needs_manifest=False)
    version, _, seconds, positives, negatives = _lines(spark, f"{path}.metadata")
    terms, width = [], 0
    for line in _lines(spark, f"{path}.model"):
        values = [float(x) for x in line.split(",")]
        width = len(values)
        terms.append({k: 1 if v == 1.0 else 0 for k, v in enumerate(values) if v != 0.0})
    return {
        "terms": terms,
        "width": width,
        "version": version,
        "training_time": float(seconds),
        "training_pos": int(positives),
        "training_neg": int(negatives),
    }
