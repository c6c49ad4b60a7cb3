"""Literals and terms as native predicates over a feature array.

A literal is an index in ``0 .. 2n-1``: ``k`` wants feature ``k`` to be 1 and
``k + n`` wants it to be 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def is_feature_set(df: DataFrame, features: str = "features") -> bool:
    """Whether the feature column is a set of active features (see ``encode.feature_set``)."""
    kind = df.schema[features].dataType
    return isinstance(kind, StructType) and {"size", "indices"} <= set(kind.names)


def feature_column(df: DataFrame, features: str = "features") -> Column:
    """The feature column as packing takes it: vectors and sets as they are, arrays as doubles."""
    if isinstance(df.schema[features].dataType, VectorUDT) or is_feature_set(df, features):
        return F.col(features)
    return F.col(features).cast("array<double>")


def feature_array(df: DataFrame, features: str = "features") -> Column:
    """The feature column as ``array<double>``, whether it is a vector or an array."""
    if isinstance(df.schema[features].dataType, VectorUDT):
        return vector_to_array(F.col(features))
    return F.col(features).cast("array<double>")


def split_literal(literal: int, width: int) -> tuple[int, int]:
    """``(feature, wanted value)`` of a literal index."""
    if not 0 <= literal < 2 * width:
        raise ValueError(f"literal {literal} is outside 0..{2 * width - 1}")
    return (literal, 1) if literal < width else (literal - width, 0)


def literal_matches(features: Column, literal: int, width: int) -> Column:
    """True where the feature has exactly the wanted value."""
    feature, want = split_literal(literal, width)
    return F.get(features, F.lit(feature)) == F.lit(float(want))


def literal_misses(features: Column, literal: int, width: int) -> Column:
    """True for the rows a literal erases."""
    return ~literal_matches(features, literal, width)


def term_allows(features: Column, term: dict[int, int]) -> Column:
    """True where no literal of ``{feature: wanted value}`` is contradicted."""
    tests = [
        F.get(features, F.lit(k)) != F.lit(1.0 - want) for k, want in sorted(term.items())
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_term_allows(features: Column, terms: list[dict[int, int]]) -> Column:
    """True where at least one term is not contradicted."""
    return reduce(lambda a, b: a | b, [term_allows(features, t) for t in terms], F.lit(False))


def set_meets(features: Column, term: dict[int, int]) -> Column:
    """:func:`term_allows` over a set of active features, which has no uncertain values."""
    held = features["indices"]
    tests = [
        F.array_contains(held, k) if want else ~F.array_contains(held, k)
        for k, want in sorted(term.items())
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_term_meets(features: Column, terms: list[dict[int, int]]) -> Column:
    """:func:`any_term_allows` over a set of active features."""
    return reduce(lambda a, b: a | b, [set_meets(features, t) for t in terms], F.lit(False))
