"""Odd inputs that every operator must take."""

from __future__ import annotations

ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "ok \t ok", "É é Ñ ß İ Σ", "x" * 5000, "tie tie tie",
    "word " * 3000, "a\r\nb\x0bc\x0cd", "\x00 nul", "😀 emoji 漢字 مرحبا", "<|endoftext|> <|startoftext|>",
    "nbsp\xa0here too  two", "The same text twice.", "The same text twice.",
]


def odd_documents(spark):
    """Nulls, ties, repeated rows, and columns whose names clash in case."""
    rows = [(i, t, f"s{i}", "TEXT", i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id at all here", None, None, None), rows[4], rows[4], (3, "three again", "s", "T", 3)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, source string, TEXT string, Doc_Id bigint"
    )


def odd_rows() -> list[tuple]:
    rows = list(enumerate(ODD_TEXTS))
    return rows + [(None, "no id at all here"), rows[4], rows[4], (3, "three again")]


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def by_row(df, *names):
    """The rows as sorted tuples."""
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
