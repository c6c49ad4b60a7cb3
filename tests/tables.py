"""Small instance tables."""

from pyspark.sql import functions as F

TESTDATA = "/root/testdata"


def instances(spark, pos, neg, partitions=None):
    rows = [(i, 1, [float(x) for x in r]) for i, r in enumerate(pos)]
    rows += [(len(pos) + i, 0, [float(x) for x in r]) for i, r in enumerate(neg)]
    df = spark.createDataFrame(rows, "id bigint, label int, features array<double>")
    return df.repartition(partitions) if partitions else df


def heads160(spark, sf, label):
    """Fixed-width reads: the first 20 characters, 8 indicator features each.

    A small fixture with known results; many steps are exact ties.
    """
    documents = spark.read.parquet(f"{TESTDATA}/sf{sf}/documents.parquet")
    labels = spark.read.parquet(f"{TESTDATA}/sf{sf}/labels.parquet")
    read = F.substring(F.lower("text"), 1, 20)
    tests = [F.substring("read", i + 1, 1) == c for i in range(20) for c in "aeinorst"]
    return (
        documents.join(labels, "doc_id")
        .withColumn("read", read)
        .select(
            F.col("doc_id").alias("id"),
            F.col(label).alias("label"),
            F.array(*[F.when(t, 1.0).otherwise(0.0) for t in tests]).alias("features"),
        )
    )
