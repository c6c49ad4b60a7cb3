"""Quality rules in a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one failure bit per rule; policies are versioned masks over these bits, so
applying another policy, or asking what a rule alone removes, reads the ledger
and never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clauseforge.llm import tables
from clauseforge.llm.shingles import giving_back, window_hashes, words_of
from clauseforge.llm.tokens import rows_of

SYMBOLS = "#*$%&|<>"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_letter_words", "n_marks",
)

# Each rule: name and the SQL test that a document fails. The place is its bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("repeated_lines", "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("few_letters", "100 * n_letter_words < 60 * n_words"),
    ("exclamations", "100 * n_marks > 50 * n_words"),
)
BITS = {name: 1 << place for place, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return reduce(lambda a, b: a | b, (BITS[r] for r in self.rules), 0)


BASE = Policy("base", ("few_words", "repeated_words"))
STANDARD = Policy("standard-1", tuple(BITS))


def measures(text: str) -> tuple[int, ...]:
    """The measurements of a text, in the order of ``MEASURES``."""
    import numpy as np

    words = words_of(text)
    n = len(words)
    repeated = 0
    if n >= 5:
        hashes = window_hashes(words)
        _, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
        again = times[place] > 1
        if again.any():
            # A word counts once however many repeated windows cover it.
            edge = np.zeros(n + 1, "i8")
            starts = np.flatnonzero(again)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + 5, -1)
            repeated = int((np.cumsum(edge[:n]) > 0).sum())
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    letters = sum(map(_has_letter, words))
    return (
        n, len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated, len(lines), letters, text.count("!"),
    )


def _has_letter(word: bytes) -> bool:
    # An ASCII letter, or a character beyond ASCII.
    return word.lower() != word.upper() or not word.isascii()


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits`` of every row of ``docs``.

    Null and empty texts have no words and fail ``few_words``. Repeated rows and
    null ids are rows like any other; further columns are left out.
    """

    def measure(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [(i, *measures(t)) for i, t in rows_of(batch, "doc_id", "text")]
            columns = list(zip(*found)) if found else [[]] * (1 + len(MEASURES))
            yield pa.record_batch(
                [pa.array(x, pa.int64()) for x in columns], names=["doc_id", *MEASURES]
            )

    schema = ", ".join(f"{name} bigint" for name in ("doc_id", *MEASURES))
    measured = tables.documents(docs, id_col, text_col).mapInArrow(giving_back(measure), schema)
    return _with_bits(measured)


def _with_bits(measured: DataFrame) -> DataFrame:
    bits = [F.when(F.expr(fails), F.lit(BITS[name])).otherwise(0) for name, fails in RULES]
    return measured.withColumn("fail_bits", reduce(lambda a, b: a + b, bits).cast("bigint"))


def apply_policy(book: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under ``policy``."""
    fails = lambda p: F.col("fail_bits").bitwiseAND(F.lit(p.mask)) != 0
    return book.withColumn("base_failed", fails(BASE)).withColumn(
        "kept", ~(F.col("base_failed") | fails(policy))
    )


def ablations(book: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Per rule of ``policy``: documents that fail it, and that it alone rejects.

    One pass of the ledger; the sums of each task are what is shuffled.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    sums = []
    for rule in policy.rules:
        bit = BITS[rule]
        sums.append(F.count_if(masked.bitwiseAND(F.lit(bit)) != 0).alias(f"{rule}_failed"))
        sums.append(F.count_if(masked == bit).alias(f"{rule}_alone"))
    totals = book.agg(F.count("*").alias("documents"), *sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(policy.version).alias("version"), F.lit(r).alias("rule"), F.col("documents"),
                F.col(f"{r}_failed").alias("failed"), F.col(f"{r}_alone").alias("alone"),
            )
            for r in policy.rules
        ]
    )
    return totals.select(F.inline(rows))


def keep_good(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """``docs`` without the rows that ``policy`` rejects, columns as they were.

    The verdict rides through the measuring pass with the row, so nothing is
    joined or shuffled.
    """
    tables.ship(docs.sparkSession)
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = f"_{docs.columns.index('text')}"

    def measure(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [measures(t or "") for t in batch.column(text).to_pylist()]
            columns = list(zip(*found)) if found else [[]] * len(MEASURES)
            yield pa.record_batch(
                [*batch.columns, *[pa.array(x, pa.int64()) for x in columns]],
                names=[*names, *MEASURES],
            )

    schema = StructType([*plain.schema.fields, *[StructField(m, LongType()) for m in MEASURES]])
    measured = plain.mapInArrow(giving_back(measure), schema)
    return apply_policy(_with_bits(measured), policy).where("kept").select(*names).toDF(*docs.columns)
