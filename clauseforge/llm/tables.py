"""Reading, choosing columns, and keeping intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.storage import fresh_path

# A side is sent to every task only where its counted rows stay below this.
BROADCAST_ROWS = 100_000
# Bytes of the batches in which rows go to Python and back; the default holds
# several times as much in memory per core.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_LIMIT = 2 << 20
# Rows that a scan holds at once; the default of 4096 is some two million words of
# whole documents in each task, in arrays that grow by doubling.
SCAN_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
SCAN_LIMIT = 512

_shipped: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Batches that fit whole documents, unless the session was built with other sizes."""
    built = spark.sparkContext.getConf()
    for name, limit in ((BATCH_BYTES, BATCH_LIMIT), (SCAN_ROWS, SCAN_LIMIT)):
        if not built.contains(name):
            spark.conf.set(name, str(limit))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Tasks import it there, so that what a worker has learnt (pieces of text, word
    hashes) serves its later tasks too.
    """
    context = spark.sparkContext
    small_batches(spark)
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    # The driver serves this file to executors as they come, so it stays until the end.
    folder = tempfile.mkdtemp(prefix="clauseforge-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, f"{package.name}-{context.applicationId}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, whatever else ``df`` carries.

    Columns are found by exact name and position, so further columns that
    differ in case only, or repeat a name, neither clash nor get in the way.
    """
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {df.columns}")
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with null text read as empty."""
    ship(docs.sparkSession)
    return pick(docs, id_col, text_col).select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files.

    The files end the lineage: what is lost with an executor is read again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast only where ``rows``, its counted size, allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(
    docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows of ``keys (doc_id, text_hash)``, columns as they were."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    doc, text = (F.col(f"_{docs.columns.index(c)}") for c in (id_col, text_col))
    keys = stored(keys.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")), "dropped")
    kept = docs.toDF(*names).join(
        small(keys, keys.count()),
        doc.cast("bigint").eqNullSafe(F.col("_doc")) & (text_hash(text) == F.col("_hash")),
        "left_anti",
    )
    return kept.toDF(*docs.columns)
