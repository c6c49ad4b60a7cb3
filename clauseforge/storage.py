"""Shared folders, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only with a local master, where driver and executors are one machine, is a
    folder made when the setting is absent; a cluster without it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    current = context.getCheckpointDir()
    if current is None:
        if not is_local(context.master):
            raise ValueError(
                f"spark.checkpoint.dir must name a folder that all executors of {context.master} share"
            )
        context.setCheckpointDir(tempfile.mkdtemp(prefix="clauseforge-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as parquet to the shared folder; the table read back, and its path.

    The files end the lineage, and filters and column choices reach them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _found(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Delete what :func:`keep_table` wrote."""
    target, files = _found(spark, path)
    files.delete(target, True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder that Spark wrote has been committed."""
    target, files = _found(spark, f"{path}/_SUCCESS")
    return files.exists(target)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies under a folder; none where there is no folder."""
    target, files = _found(spark, path)
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []
