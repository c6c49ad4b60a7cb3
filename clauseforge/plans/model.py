"""The learned formula: classify with it, look at it, keep it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.functions.formula import formula_text
from clauseforge.functions.masks import Mask, pack_word, word_count
from clauseforge.functions.predicates import (
    any_term_allows,
    any_term_meets,
    feature_array,
    is_feature_set,
)
from clauseforge.sources import model_store

# Above this many literals the predicate is evaluated over word masks, because
# generated code for thousands of comparisons no longer compiles well.
INLINE_LITERALS = 256
TERM_INDEX = "array<array<struct<ones:array<bigint>,zeros:array<bigint>>>>"


@dataclass
class RuleModel:
    """A disjunction of terms, each ``{feature: wanted value}`` over 0-based features."""

    terms: list[dict[int, int]]
    width: int
    version: str = ""
    training_time: float = 0.0
    training_pos: int = 0
    training_neg: int = 0
    trace: list = field(default_factory=list, compare=False, repr=False)

    @property
    def formula(self) -> str:
        return formula_text(self.terms)

    @property
    def term_arrays(self) -> list[list[float]]:
        """Terms as rows of n numbers: 0 any value, 1 wants 1, 2 wants 0."""
        return [
            [0.0 if k not in t else (1.0 if t[k] else 2.0) for k in range(self.width)]
            for t in self.terms
        ]

    def terms_table(self, spark: SparkSession) -> DataFrame:
        """``(term_no, feature, want)``, one row per literal."""
        rows = [
            (no, k, want)
            for no, term in enumerate(self.terms, start=1)
            for k, want in sorted(term.items())
        ]
        return spark.createDataFrame(rows, "term_no int, feature int, want int")

    def metadata_table(self, spark: SparkSession) -> DataFrame:
        row = (
            self.version, self.formula, float(self.training_time),
            self.training_pos, self.training_neg, self.width, len(self.terms),
        )
        return spark.createDataFrame([row], model_store.METADATA_SCHEMA)

    def predicate(self, features: Column) -> Column:
        """True where the formula accepts an ``array<double>`` of the model's width."""
        if sum(len(t) for t in self.terms) <= INLINE_LITERALS:
            return any_term_allows(features, self.terms)
        return self._mask_predicate(features)

    def _mask_predicate(self, features: Column) -> Column:
        """Word masks of the few terms that a row can meet, found by an index.

        Every term that wants some feature to be 1 stands under one such feature; a row
        looks under the features it has, and at the terms that want no feature.
        """
        words = range(word_count(self.width))
        # What is not 0 is possible; what is 1 is sure.
        possible = F.array(*[F.bitwise_not(pack_word(features, i, 0.0)) for i in words])
        sure = F.array(*[pack_word(features, i, 1.0) for i in words])
        had = F.filter(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda k: F.get(features, k) != 0.0)
        row = F.struct(possible.alias("possible"), sure.alias("sure"), had.alias("had"))
        # One literal, read once when the query is planned.
        index = F.from_json(F.lit(json.dumps(self.term_index())), TERM_INDEX)

        def allowed(term: Column, row: Column) -> Column:
            tests = []
            for i in words:
                one, zero = term["ones"][i], term["zeros"][i]
                tests.append(row["possible"][i].bitwiseAND(one) == one)
                tests.append(row["sure"][i].bitwiseAND(zero) == F.lit(0))
            return reduce(lambda a, b: a & b, tests)

        def any_under(place: Column, row: Column) -> Column:
            return F.exists(F.get(index, place), lambda t: allowed(t, row))

        # The one-element array binds the packed row once for all terms.
        return F.exists(
            F.array(row),
            lambda r: F.exists(r["had"], lambda k: any_under(k, r)) | any_under(F.lit(self.width), r),
        )

    def term_index(self) -> list[list[dict]]:
        """Masks of the terms under the feature each stands under, then those of terms without one.

        A term stands under the wanted feature that the fewest terms want.
        """
        wanted = [0] * self.width
        for term in self.terms:
            for k, want in term.items():
                wanted[k] += want
        index: list[list[dict]] = [[] for _ in range(self.width + 1)]
        for term in self.terms:
            ones = [k for k, want in term.items() if want]
            place = min(ones, key=lambda k: (wanted[k] + len(index[k]), k), default=self.width)
            mask = Mask.of(term, self.width)
            index[place].append({"ones": _signed_words(mask.ones), "zeros": _signed_words(mask.zeros)})
        return index

    def transform(self, instances: DataFrame, features: str = "features") -> DataFrame:
        """``instances`` with ``class``: 1.0 where a term is not contradicted, else 0.0.

        One projection without a shuffle, for batch and streaming tables alike. A
        row of another width, or with other values or nulls, is an error.
        """
        if is_feature_set(instances, features):
            held = F.col(features)
            test = any_term_meets(held, self.terms)
            indices = held["indices"]
            inside = (F.array_min(indices) >= 0) & (F.array_max(indices) < self.width)
            # Without its nulls a list of indices is as long as with them.
            sound = (held["size"] == self.width) & ((F.size(indices) == 0) | inside) & (
                F.size(F.array_compact(indices)) == F.size(indices)
            )
        else:
            values = feature_array(instances, features)
            test = self.predicate(values)
            # Null and NaN are other values too.
            others = F.array_except(values, F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0)]))
            sound = (F.size(values) == self.width) & (F.size(others) == 0)
        accepted = F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))
        message = F.lit(f"a feature vector is not {self.width} values of 0, 0.5 or 1")
        # A null test is not true either.
        checked = F.when(sound, accepted).otherwise(F.raise_error(message).cast("double"))
        return instances.withColumn("class", checked)

    def save(self, spark: SparkSession, path: str, fmt: str = "parquet") -> None:
        """Write ``<path>.model``, ``<path>.metadata`` and, last, ``<path>.manifest``; none may exist yet."""
        if fmt == "csv":
            model_store.write_lines(spark, path, self)
        elif fmt == "parquet":
            model_store.write_tables(self.terms_table(spark), self.metadata_table(spark), path)
        else:
            raise ValueError("fmt must be 'parquet' or 'csv'")


def _signed_words(words: tuple[int, ...]) -> list[int]:
    return [w - (1 << 64) if w >> 63 else w for w in words]


def load_model(spark: SparkSession, path: str, fmt: str = "parquet") -> RuleModel:
    """The model saved under ``path``, given without an extension."""
    read = {"parquet": model_store.read_tables, "csv": model_store.read_lines}
    if fmt not in read:
        raise ValueError("fmt must be 'parquet' or 'csv'")
    return RuleModel(**read[fmt](spark, path))
