"""Token counts through a cache of content digests.

The cache is a Parquet table of ``(content, version, n_tokens)``: the SHA-256 of
a text after normalisation, that of the tokenizer's file, and the count. Only
distinct contents without a stored count are encoded and appended. Runs at the
same time may append a pair twice, with the same count; readers take one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.llm import tables, tokens

CACHE_SCHEMA = "content binary, version string, n_tokens bigint"


def tokenizer_version(name: str) -> str:
    with open(tokens.tokenizer_path(name), "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """Digest of ``text`` with blanks and line ends run together and trimmed.

    The vocabulary drops white space between pieces, so that texts which differ
    only there have the same count.
    """
    return F.unhex(F.sha2(F.trim(F.regexp_replace(text, "[ \n]+", " ")), 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """``(content, n_tokens)`` of one tokenizer version, one row per content."""
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == version)
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def open_cache(spark: SparkSession, path: str) -> None:
    """Make the table at ``path`` where there is none."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)


def encode_misses(misses: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """Counts of ``misses (content, text)`` as rows of the cache."""

    def encode(batches) -> Iterator:
        import pyarrow as pa

        counter = tokens.piece_counter(tokenizer)
        # Rows that repeat a document meet in one task.
        seen: set[bytes] = set()
        for batch in batches:
            contents, counts = [], []
            for content, text in tokens.rows_of(batch, "content", "text"):
                if content not in seen:
                    seen.add(content)
                    contents.append(content)
                    counts.append(counter.count(text))
            yield pa.record_batch(
                [
                    pa.array(contents, pa.binary()),
                    pa.array([version] * len(counts), pa.string()),
                    pa.array(counts, pa.int64()),
                ],
                names=["content", "version", "n_tokens"],
            )

    return misses.select("content", "text").mapInArrow(encode, CACHE_SCHEMA)


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, from_cache`` of every row; the cache at ``cache`` grows.

    ``from_cache`` tells whether the count was stored before this call.
    Null and empty texts have no bytes and no tokens. Repeated rows and copies
    are encoded once. Rows with a null id count like any other. An empty table
    gives no rows and leaves the cache as it was.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    open_cache(spark, cache)
    plain = tables.documents(docs, id_col, text_col)
    keyed = plain.select("doc_id", "text", content_digest(F.col("text")).alias("content"))
    slim = tables.stored(
        keyed.select("doc_id", "content", F.octet_length("text").cast("bigint").alias("n_bytes")),
        "digests",
    )
    # One document stands for each distinct content that has no count yet.
    distinct = slim.groupBy("content").agg(
        F.min("doc_id").alias("doc_id"), F.count("doc_id").alias("with_id")
    )
    # The files there are now; what is appended below is not among them.
    known = read_cache(spark, cache, version).select("content")
    hits = known.select(F.col("content").alias("hit"))
    wanted = distinct.join(known, "content", "left_anti")
    misses = keyed.join(
        wanted.select(F.col("doc_id").alias("w_id"), F.col("content").alias("w_content"))
        .hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("content") == F.col("w_content")),
    )
    encode_misses(misses, tokenizer, version).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version)
    counts = counts.join(hits, F.col("content") == F.col("hit"), "left")
    return slim.join(counts, "content").select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
        F.col("hit").isNotNull().alias("from_cache"),
    )
