"""Instance tables over the driver's tables, all rows and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.functions.encode import feature_set

# The features of the part table, in order.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PART_WORDS = [
    "anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large",
    "new", "old", "plate", "red", "ring", "rod", "small", "widget",
]
# Words looked for in the whole of a document.
DOCUMENT_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "ch", "de", "des", "die", "en", "er", "es",
    "for", "from", "in", "is", "it", "la", "le", "les", "of", "on", "ou", "que", "re", "sch", "that",
    "the", "this", "th", "tion", "to", "und", "was", "with",
]
DOCUMENT_LANGUAGES = ["de", "en", "es", "fr"]

LINE_NUMBERS = [1, 2, 3, 4, 5, 6, 7]
LINE_STATUSES = ["F", "O"]
LINE_PERCENTS = list(range(11))
LINE_YEARS = list(range(1992, 2002))

PART_WIDTH = len(PART_TYPES) + 5 + len(PART_WORDS)
DOCUMENT_WIDTH = len(DOCUMENT_LANGUAGES) + len(DOCUMENT_WORDS)
# One feature per first two letters of a word and per length 2, 3 and more.
WORD_WIDTH = 26 * 26 * 3
LINE_WIDTH = len(LINE_NUMBERS) + len(LINE_STATUSES) + len(LINE_PERCENTS) + len(LINE_YEARS)

PART_RULE = (
    "(p_type = 'ECONOMY' AND p_size % 5 = 0) OR (p_type = 'PROMO' AND p_size % 5 <> 1)"
)


# A document is positive by this rule over its features.
DOCUMENT_RULE = (
    "(lang = 'de' AND array_contains(__words, 'und')) OR "
    "(lang = 'en' AND array_contains(__words, 'with') AND NOT array_contains(__words, 'by'))"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widened(df: DataFrame) -> DataFrame:
    """``df`` over all cores when it comes in fewer pieces than there are cores.

    For tables of one or two small files whose rows cost much to process; a
    table of many files passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def indicator(test: Column) -> Column:
    return F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))


def part_features(part: DataFrame) -> DataFrame:
    """``part`` with 27 yes/no features: its type, ``p_size % 5``, the words of its name."""
    words = F.split("p_name", " ")
    tests = (
        [F.col("p_type") == t for t in PART_TYPES]
        + [F.col("p_size") % 5 == r for r in range(5)]
        + [F.array_contains(words, w) for w in PART_WORDS]
    )
    return part.withColumn("features", F.array(*[indicator(t) for t in tests]))


def uncertain_part_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`part_instances`, where the ``p_size % 5`` features of large parts are uncertain."""
    part = part_features(table(spark, sf_dir, "part"))
    sizes = range(len(PART_TYPES), len(PART_TYPES) + 5)
    blurred = F.transform(
        "features",
        lambda x, i: F.when((F.col("p_size") > 40) & i.isin(list(sizes)), F.lit(0.5)).otherwise(x),
    )
    return part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.expr(PART_RULE), 1).otherwise(0).alias("label"),
        blurred.alias("features"),
    )


def part_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label, features)`` with a label that follows a known rule."""
    part = part_features(table(spark, sf_dir, "part"))
    return part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.expr(PART_RULE), 1).otherwise(0).alias("label"),
        "features",
    )


def lineitem_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table: returned lines against the others, few vectors with many copies."""
    lines = table(spark, sf_dir, "lineitem")
    percent = F.round(F.col("l_discount") * 100).cast("int")
    tests = (
        [F.col("l_linenumber") == x for x in LINE_NUMBERS]
        + [F.col("l_linestatus") == x for x in LINE_STATUSES]
        + [percent == x for x in LINE_PERCENTS]
        + [F.year("l_shipdate") == x for x in LINE_YEARS]
    )
    return lines.select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.array(*[indicator(t) for t in tests]).alias("features"),
    )


def line_detail_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines against the others, with tens of thousands of distinct vectors per side."""
    lines = table(spark, sf_dir, "lineitem")
    tests = (
        [F.col("l_quantity") == x for x in range(1, 51)]
        + [F.round(F.col("l_discount") * 100).cast("int") == x for x in LINE_PERCENTS]
        + [F.round(F.col("l_tax") * 100).cast("int") == x for x in range(9)]
        + [F.col("l_linenumber") == x for x in LINE_NUMBERS]
    )
    return lines.select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.array(*[indicator(t) for t in tests]).alias("features"),
    )


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label, seq)``: order dates as ten-character sequences; March and December are positive."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.month("o_orderdate").isin(3, 12).cast("int").alias("label"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("seq"),
    )


def ascii_words(text: Column) -> Column:
    """The distinct lower-case ASCII words of a whole text.

    Distinct words are put in lower case together, once they are few and ASCII: looking
    up every character of the text cost more than taking it apart.
    """
    found = F.array_distinct(F.split(text, "[^A-Za-z]+"))
    return F.array_distinct(F.split(F.lower(F.array_join(found, " ")), " "))


def listed_words(words: Column) -> Column:
    """Those of the words that are in the list."""
    return F.array_intersect(F.array(*[F.lit(w) for w in DOCUMENT_WORDS]), words)


def document_words(text: Column) -> Column:
    """The distinct lower-case ASCII words of a whole text that are in the list."""
    return listed_words(ascii_words(text))


def document_features(documents: DataFrame) -> DataFrame:
    """``documents`` with one feature per language and per listed word."""
    found = documents.withColumn("__words", document_words(F.col("text")))
    tests = [F.col("lang") == x for x in DOCUMENT_LANGUAGES] + [
        F.array_contains("__words", w) for w in DOCUMENT_WORDS
    ]
    return found.withColumn("features", F.array(*[indicator(t) for t in tests])).drop("__words")


def document_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label, features)`` of all documents, with a label that follows a known rule."""
    documents = widened(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    named = documents.withColumn("__words", document_words(F.col("text")))
    ruled = named.withColumn("label", F.when(F.expr(DOCUMENT_RULE), 1).otherwise(0)).drop("__words")
    return document_features(ruled).select(F.col("doc_id").alias("id"), "label", "features")


def word_shape_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label, features)`` of all documents: the shapes of all their words, as sets of features."""
    documents = widened(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    # Both the label and the features read this column, so the text is taken apart once.
    named = documents.withColumn("__found", ascii_words(F.col("text")))
    named = named.withColumn("__words", listed_words(F.col("__found")))
    words = F.filter("__found", lambda w: F.length(w) >= 2)

    def shape(word: Column) -> Column:
        letters = (F.ascii(word) - 97) * 26 + F.ascii(F.substring(word, 2, 1)) - 97
        return letters * 3 + F.least(F.length(word), F.lit(4)) - 2

    return named.select(
        F.col("doc_id").alias("id"),
        F.when(F.expr(DOCUMENT_RULE), 1).otherwise(0).alias("label"),
        feature_set(F.array_distinct(F.transform(words, shape)), WORD_WIDTH).alias("features"),
    )


def judged_document_instances(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """``(id, label, features)`` of the labelled documents; some vectors carry both labels."""
    documents = widened(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    return document_features(documents.join(labels, "doc_id")).select(
        F.col("doc_id").alias("id"), "label", "features"
    )
