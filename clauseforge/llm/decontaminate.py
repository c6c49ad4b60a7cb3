"""Benchmark decontamination with a positional inverted index.

Documents are cut into words once. For every window of a benchmark item the two
rarest of its terms, by their counts over all documents, are looked up: the
index holds the postings ``(term, row, position)`` of these terms. A posting
less the place of its term in the item is the place where the item would start;
places that both lists of a window could agree on are candidates, and the words
there are compared one by one. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseforge.llm import tables

WINDOW = 10
SEEDS = 2

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = "".join(
    map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
)


def words(text: Column) -> Column:
    """Words of digits, letters and characters beyond ASCII, A-Z in lower case."""
    plain = F.translate(text, _BREAKS + _UPPER, " " * len(_BREAKS) + _UPPER.lower())
    return F.array_remove(F.split(plain, " "), "")


def word_table(texts: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``row, id, text_hash, words`` of every row, stored; ``row`` names the row from then on."""
    tables.small_batches(texts.sparkSession)
    plain = tables.pick(texts, id_col, text_col)
    return tables.stored(
        plain.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            tables.text_hash(F.col(text_col)).alias("text_hash"),
            words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"),
        ),
        name,
    )


def item_terms(items: DataFrame) -> DataFrame:
    """``item, place, term, length`` of every word of ``items``."""
    return items.select(
        F.col("row").alias("item"),
        F.size("words").alias("length"),
        F.posexplode("words").alias("place", "term"),
    )


def term_counts(corpus: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """``term, n``: how often each of ``terms`` occurs in all documents."""
    found = corpus.select(F.explode("words").alias("term")).join(
        tables.small(terms, n_terms), "term"
    )
    return found.groupBy("term").agg(F.count("*").alias("n"))


def window_seeds(terms: DataFrame, counts: DataFrame, window: int, seeds: int) -> DataFrame:
    """``item, place, term, needed``: the rarest terms of every window of every item."""
    known = terms.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # The windows a word stands in: they start at most window - 1 places before it.
    last = F.greatest(F.lit(0), F.col("length") - window)
    starts = F.sequence(
        F.greatest(F.lit(0), F.col("place") - window + 1), F.least(F.col("place"), last)
    )
    order = Window.partitionBy("item", "start").orderBy("n", "place")
    return (
        known.withColumn("start", F.explode(starts))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= seeds)
        .groupBy("item", "place", "term")
        .agg(F.min(F.least(F.lit(seeds), "length")).alias("needed"))
    )


def postings(corpus: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The inverted index of ``terms``: ``term, row, position``."""
    return corpus.select("row", F.posexplode("words").alias("position", "term")).join(
        tables.small(terms, n_terms), "term"
    )


def candidates(index: DataFrame, seeds: DataFrame, n_seeds: int) -> DataFrame:
    """``row, item, shift``: where enough offset-adjusted postings meet."""
    shifted = index.join(tables.small(seeds, n_seeds), "term").select(
        "row", "item", (F.col("position") - F.col("place")).alias("shift"), "place", "needed"
    )
    return (
        shifted.groupBy("row", "item", "shift")
        .agg(F.count("*").alias("met"), F.min("needed").alias("needed"))
        .where("met >= needed")
        .select("row", "item", "shift")
    )


def occurrences(
    found: DataFrame, corpus: DataFrame, items: DataFrame, n_items: int, window: int
) -> DataFrame:
    """``row, item, shift, starts``: windows of the item that stand there word for word."""
    grouped = found.groupBy("row").agg(F.collect_set(F.struct("item", "shift")).alias("at"))
    grouped = tables.stored(grouped, "candidates")
    there = corpus.select("row", "words").join(tables.small(grouped, grouped.count()), "row")
    lengths = items.select(F.col("row").alias("item"), F.col("words").alias("item_words"))
    at = there.select("row", "words", F.explode("at").alias("at")).select(
        "row", F.col("at.item").alias("item"), F.col("at.shift").alias("shift"), "words"
    )
    equal = F.transform(
        F.col("item_words"), lambda w, i: F.coalesce(F.get("words", F.col("shift") + i) == w, F.lit(False))
    )
    span = F.least(F.lit(window), F.size("item_words"))
    compared = at.join(tables.small(lengths, n_items), "item").select(
        "row", "item", "shift", equal.alias("equal"), span.alias("span")
    )
    starts = F.filter(
        F.sequence(F.lit(0), F.size("equal") - F.col("span")),
        lambda s: F.forall(F.slice("equal", s + 1, F.col("span")), lambda x: x),
    )
    return compared.withColumn("starts", starts).where(F.size("starts") > 0).select(
        "row", "item", "shift", "span", "starts"
    )


def find_items(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
    item_id: str = "item_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored words of the documents, those of the items, and the occurrences."""
    corpus = word_table(docs, doc_id, text_col, "corpus-words")
    items = word_table(benchmark, item_id, text_col, "item-words").where(F.size("words") > 0)
    n_items = items.count()
    terms = tables.stored(item_terms(items), "item-terms")
    distinct = terms.select("term").distinct()
    counts = tables.stored(term_counts(corpus, distinct, distinct.count()), "term-counts")
    seeds = tables.stored(window_seeds(terms, counts, window, SEEDS), "seeds")
    n_seeds = seeds.count()
    index = tables.stored(
        postings(corpus, seeds.select("term").distinct(), n_seeds), "postings"
    )
    found = occurrences(candidates(index, seeds, n_seeds), corpus, items, n_items, window)
    return corpus, items, found


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
    item_id: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs, columns as they were."""
    corpus, _, found = find_items(docs, benchmark, window, doc_id, item_id, text_col)
    rows = tables.stored(found.select("row").distinct(), "contaminated")
    keys = corpus.select("row", F.col("id").cast("bigint").alias("doc_id"), "text_hash").join(
        tables.small(rows, rows.count()), "row"
    )
    return tables.without(docs, keys.select("doc_id", "text_hash").distinct(), doc_id, text_col)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
    item_id: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A null text has no words and is clean, as is an empty one; an item without
    words occurs nowhere, and items that share an item_id are one item. Repeated
    rows and null ids are rows of their own. With an empty benchmark every row
    is clean; an empty table gives no rows. Further columns are left out.
    """
    corpus, items, found = find_items(docs, benchmark, window, doc_id, item_id, text_col)
    found = tables.stored(found, "occurrences")
    positions = F.flatten(
        F.transform(
            "starts",
            lambda s: F.sequence(F.col("shift") + s, F.col("shift") + s + F.col("span") - 1),
        )
    )
    hits = (
        found.select("row", F.explode(F.array_distinct(positions)).alias("position"))
        .distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    )
    names = items.select(
        F.col("row").alias("item"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name")
    )
    # One row per document and item: a document holds each item's name once.
    listed = (
        found.select("row", "item").distinct().join(names, "item")
        .groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("names"))
    )
    none = F.array().cast("array<string>")
    return (
        corpus.select("row", F.col("id").alias("doc_id"), F.size("words").cast("bigint").alias("n_words"))
        .join(hits, "row", "left").join(listed, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.size(F.coalesce("names", none)).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("names", none), ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def proximity(
    docs: DataFrame, benchmark: DataFrame, slop: int = 5, window: int = WINDOW,
    doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, places``: the two rarest terms of a window stand near each other.

    Near means that the places where the item would start by either term differ
    by at most ``slop``. Only neighbours in the order of these places are compared.
    """
    corpus = word_table(docs, doc_id, text_col, "corpus-words")
    items = word_table(benchmark, item_id, text_col, "item-words").where(F.size("words") > 0)
    terms = tables.stored(item_terms(items), "item-terms")
    distinct = terms.select("term").distinct()
    counts = tables.stored(term_counts(corpus, distinct, distinct.count()), "term-counts")
    seeds = tables.stored(window_seeds(terms, counts, window, SEEDS), "seeds")
    n_seeds = seeds.count()
    index = postings(corpus, seeds.select("term").distinct(), n_seeds)
    shifted = index.join(tables.small(seeds, n_seeds), "term").select(
        "row", "item", (F.col("position") - F.col("place")).alias("shift"), "place", "needed"
    )
    order = Window.partitionBy("row", "item").orderBy("shift", "place")
    close = shifted.withColumn("before", F.lag("shift").over(order)).withColumn(
        "place_before", F.lag("place").over(order)
    ).where(
        (F.col("needed") == 1)
        | ((F.col("shift") - F.col("before") <= slop) & (F.col("place") != F.col("place_before")))
    )
    return (
        close.groupBy("row", "item").agg(F.count("*").alias("places"))
        .join(corpus.select("row", F.col("id").alias("doc_id")), "row")
        .join(items.select(F.col("row").alias("item"), F.col("id").alias("item_id")), "item")
        .select("doc_id", "item_id", "places")
    )
