"""Formula text: 1-based literals in feature order, ``^`` after a negated one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_text(term: dict[int, int]) -> str:
    return "".join(f"x{k + 1}" + ("" if want else "^") for k, want in sorted(term.items()))


def formula_text(terms: list[dict[int, int]]) -> str:
    return " + ".join(term_text(t) for t in terms)


def formula_column(terms: DataFrame) -> DataFrame:
    """The same text from a terms table ``(term_no, feature, want)``, one row per term."""
    literal = F.concat(
        F.lit("x"), (F.col("feature") + 1).cast("string"), F.when(F.col("want") == 0, "^").otherwise("")
    )
    ordered = F.array_sort(F.collect_list(F.struct("feature", literal.alias("text"))))
    return terms.groupBy("term_no").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("term_text")
    )
