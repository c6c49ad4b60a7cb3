"""Shards by extendible hashing.

The directory is indexed by the first bits of a row's hash. A bucket that is
over the byte limit splits on one more bit; the others stay. Where a bucket
ends is the shortest prefix whose rows fit, so the sums of bytes over the
prefixes of some length tell all splits of that many bits at once; what is
still too large goes on with more bits. All of it is DataFrame operations.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.llm import tables

HASH_BITS = 60
LIMIT = 1 << 20
# Bits that one round looks at beyond those that even buckets would need.
SPARE_BITS = 4


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of the row."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _split(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Per occupied cell of ``high`` bits: the depth from ``low`` on where its rows fit, or null."""
    cells = rows.select(
        "path", F.expr(f"shiftright(hash, {HASH_BITS - high})").alias("cell"), "n_bytes"
    ).groupBy("path", "cell").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
    cells = tables.stored(cells, "cells")
    above = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, {high} - depth)")
    )
    keys = ["path", "depth", "prefix"]
    sums = above.groupBy(keys).agg(
        F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows")
    )
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    found = above.select("cell", *keys).join(fits, keys).groupBy("path", "cell").agg(
        F.min_by(F.struct("depth", "prefix", "shard_bytes"), "depth").alias("shard")
    )
    return cells.select("path", "cell").join(found, ["path", "cell"], "left").select(
        "path", "cell", "shard.*"
    )


def assign(
    docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes`` of every row of ``docs``.

    ``shard`` is a prefix as a string of bits, of all shards' the only one that
    its rows' hashes begin with. A row over the limit has a shard of its own.
    Rows that are equal in id and text share their hash; where they alone are
    over the limit, bits of a hash of their places in the stored table follow
    after a ``+``. Null texts have no bytes; an empty table gives no rows;
    further columns are left out.
    """
    return _assigned(_numbered(docs, id_col, text_col), limit).drop("row")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, text``; the numbers stay the same once they are written."""
    plain = tables.documents(docs, id_col, text_col)
    return plain.withColumn("row", F.monotonically_increasing_id())


def _assigned(rows: DataFrame, limit: int) -> DataFrame:
    """``row`` and the columns of :func:`assign`; what is written of ``rows`` has no texts."""
    left = tables.stored(
        rows.select(
            "row",
            "doc_id",
            F.octet_length("text").cast("bigint").alias("n_bytes"),
            row_hash(F.col("doc_id"), F.col("text")).alias("hash"),
            F.lit("").alias("path"),
        ),
        "row-hashes",
    )
    columns = left.columns
    total = left.agg(F.sum("n_bytes")).first()[0] or 0
    even = math.ceil(math.log2(max(1.0, total / limit)))
    low, high, done = 0, min(HASH_BITS, even + SPARE_BITS), []
    while True:
        directory = tables.stored(_split(left, low, high, limit), "directory")
        cell = F.expr(f"shiftright(hash, {HASH_BITS - high})")
        placed = left.withColumn("cell", cell).join(
            tables.small(directory, directory.count()), ["path", "cell"]
        )
        bits = F.when(F.col("depth") > 0, F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
        done.append(
            placed.where(F.col("depth").isNotNull()).select(
                "row", "doc_id", "n_bytes",
                F.concat("path", F.coalesce(bits, F.lit(""))).alias("shard"),
                (F.length("path") + F.col("depth")).alias("depth"),
                "shard_bytes",
            )
        )
        if directory.where(F.col("depth").isNull()).isEmpty():
            return reduce(DataFrame.unionByName, done)
        over = placed.where(F.col("depth").isNull())
        if high < HASH_BITS:
            low, high = high, min(HASH_BITS, high + 8)
        else:
            again = F.conv(F.substring(F.md5(F.col("row").cast("string")), 1, HASH_BITS // 4), 16, 10)
            over = over.withColumn(
                "path", F.concat("path", F.lpad(F.bin("hash"), HASH_BITS, "0"), F.lit("+"))
            ).withColumn("hash", again.cast("bigint"))
            low, high = 0, 8
        left = tables.stored(over.select(*columns), "oversized")


def write_shards(
    docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write ``doc_id, text`` of every row of ``docs`` into the folder of its shard, as one file.

    Null texts are written as empty ones; rows as in :func:`assign`.
    """
    rows = tables.stored(_numbered(docs, id_col, text_col), "rows")
    places = tables.stored(_assigned(rows, limit).select("row", "shard"), "places")
    # The letter keeps the only shard of a small table, which has no bits, a name.
    named = rows.join(places, "row").select("doc_id", "text", F.concat(F.lit("b"), "shard").alias("shard"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text, shard`` of what :func:`write_shards` wrote."""
    files = spark.read.schema("doc_id bigint, text string, shard string").parquet(path)
    return files.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.substring("shard", 2, 1 << 20).alias("shard"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The columns of :func:`assign`, measured on the rows in the files."""
    rows = open_shards(spark, path).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "shard"
    )
    sizes = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    bits = F.length(F.regexp_replace("shard", r"\+", "")).alias("depth")
    return rows.join(sizes, "shard").select("doc_id", "n_bytes", "shard", bits, "shard_bytes")
