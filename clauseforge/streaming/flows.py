"""Streaming counts and streaming classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseforge.plans.model import RuleModel
from clauseforge.storage import discard, folder_names, is_complete

# Batch folders after which they are merged into one.
MERGE_AFTER = 8


def counts(stream: DataFrame, key: str = "seq") -> DataFrame:
    """Running number of rows per distinct ``key``."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def to_memory(stream: DataFrame, name: str, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Keep the complete result as the table ``name`` on the driver, for small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode("complete")
    return _start(writer, checkpoint, once)


def to_keyed(
    stream: DataFrame, path: str, checkpoint: str, once: bool = False, key: str = "seq", merge_after: int = MERGE_AFTER
) -> StreamingQuery:
    """Keep the counts that each batch changes as files under ``path``.

    A batch is a folder; every ``merge_after`` batches the folders are merged into one
    that holds all keys as of the last of them. Nothing of the result passes through
    the driver, however many keys there are; :func:`read_keyed` reads it.

    A batch that runs again writes its folder anew. A merged folder counts once it is
    complete, and what it replaces is deleted only at the merge after it, so a
    stopped merge loses nothing and a reader that has begun can end.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        merge_batches(batch.sparkSession, path, key, merge_after)

    return _start(stream.writeStream.outputMode("update").foreachBatch(write), checkpoint, once)


def _kept_folders(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the complete merged folders and of the batch folders, ascending."""
    names = folder_names(spark, path)

    def numbers(kind: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))

    return [n for n in numbers("merged") if is_complete(spark, f"{path}/merged={n}")], numbers("batch")


def _current(spark: SparkSession, path: str) -> list[str]:
    """The latest merged folder and the batches after it."""
    merged, batches = _kept_folders(spark, path)
    last = merged[-1] if merged else -1
    return [f"{path}/merged={n}" for n in merged[-1:]] + [f"{path}/batch={n}" for n in batches if n > last]


def merge_batches(spark: SparkSession, path: str, key: str = "seq", merge_after: int = MERGE_AFTER) -> bool:
    """Merge the batches since the last merge if there are ``merge_after`` of them; tells whether it did."""
    merged, batches = _kept_folders(spark, path)
    fresh = [n for n in batches if n > (merged[-1] if merged else -1)]
    if len(fresh) < merge_after:
        return False
    _latest(spark, _current(spark, path), key).write.mode("overwrite").parquet(f"{path}/merged={fresh[-1]}")
    # What the merge before this one has replaced.
    for n in merged[:-1]:
        discard(spark, f"{path}/merged={n}")
    for n in [n for n in batches if merged and n <= merged[-1]]:
        discard(spark, f"{path}/batch={n}")
    return True


def _latest(spark: SparkSession, folders: list[str], key: str) -> DataFrame:
    # Counts only grow, so the largest is the latest.
    return spark.read.parquet(*folders).groupBy(key).agg(F.max("count").alias("count"))


def read_keyed(spark: SparkSession, path: str, key: str = "seq") -> DataFrame:
    """``(key, count)`` as of the last batch that changed each key."""
    return _latest(spark, _current(spark, path), key)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append rows to parquet files, each input row exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer, checkpoint, once)


def _start(writer, checkpoint: str | None, once: bool) -> StreamingQuery:
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def classify(stream: DataFrame, model: RuleModel, features: str = "features") -> DataFrame:
    """The stream with ``class``; the same projection as for a batch table."""
    return model.transform(stream, features)
