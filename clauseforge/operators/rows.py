"""Which input rows a literal erases and a term covers.

Rows keep a key through packing. Where a table is read from Parquet files, the key
is the file and the row's number in it, which no partitioning changes and which
names one row. Elsewhere it is a digest of the features, which names all rows that
are alike; no rule can tell those apart.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseforge.functions.masks import Mask, half_columns, one_columns, word_text
from clauseforge.functions.predicates import split_literal
from clauseforge.operators.instances import pack

PLACE = "row_place"


def with_place(df: DataFrame) -> DataFrame:
    """``df`` with ``row_place``: file and row number, null where no single file row stands behind a row."""
    try:
        place = F.concat_ws("#", "_metadata.file_path", "_metadata.row_index")
        return df.withColumn(PLACE, place)
    except AnalysisException:
        return df.withColumn(PLACE, F.lit(None).cast("string"))


def vector_digest(width: int) -> Column:
    """SHA-256 of a packed row: its ones as 0/1 text, then its uncertain values if it has any."""
    ones, halves = word_text(one_columns(width), width), word_text(half_columns(width), width)
    return F.sha2(F.concat(ones, F.when(F.instr(halves, "1") > 0, F.concat(F.lit(":"), halves)).otherwise("")), 256)


def keyed_rows(
    df: DataFrame, width: int, features: str = "features", keep: list[str] | None = None, digests: bool = False
) -> DataFrame:
    """``(keep.., row_key, w*, h*)`` of every row.

    ``row_key`` is its place, else its digest; with ``digests`` always its digest.
    """
    kept = list(keep or [])
    placed = df.withColumn(PLACE, F.lit(None).cast("string")) if digests else with_place(df)
    packed = pack(placed.select(*kept, PLACE, features), width, features, keep=[*kept, PLACE])
    key = F.coalesce(F.col(PLACE), vector_digest(width)).alias("row_key")
    return packed.select(*kept, key, *one_columns(width), *half_columns(width))


def covered_rows(
    df: DataFrame, terms: list[dict[int, int]], width: int, features: str = "features",
    keep: list[str] | None = None, digests: bool = False,
) -> DataFrame:
    """``(keep.., row_key, term_no)`` of the rows that some term covers, under the first that does.

    A term covers a row that contradicts none of its literals. This is how training
    takes rows away, term by term.
    """
    rows = keyed_rows(df, width, features, keep, digests)
    return _numbered(rows, [Mask.of(t, width).allows(True) for t in terms], "term_no", keep)


def erased_rows(
    df: DataFrame, literals: list[int], width: int, features: str = "features", keep: list[str] | None = None,
    digests: bool = False,
) -> DataFrame:
    """``(keep.., row_key, step)`` of the rows that a term's literals erase, in their order.

    A literal erases the rows that do not meet it exactly; rows that meet all of
    them are not in the result.
    """
    rows = keyed_rows(df, width, features, keep, digests)
    masks = [Mask.of(dict([split_literal(k, width)]), width) for k in literals]
    return _numbered(rows, [~m.exact(True) for m in masks], "step", keep)


def _numbered(rows: DataFrame, tests: list[Column], name: str, keep: list[str] | None) -> DataFrame:
    """The number of the first test a row passes, for rows that pass one."""
    first = F.lit(None).cast("int")
    for no, test in reversed(list(enumerate(tests, start=1))):
        first = F.when(test, F.lit(no)).otherwise(first)
    return rows.select(*(keep or []), "row_key", first.alias(name)).where(F.col(name).isNotNull())
