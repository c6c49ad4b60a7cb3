"""Labelled instances as packed, counted, distinct vectors.

One shuffle turns the instance table into rows ``(w0.., half, pos, neg)``: each
distinct vector once, with the number of positives and negatives that carry it.
``half`` is null but for vectors with uncertain values, so 0/1 data does not
carry them through the shuffle.
Counting happens before the shuffle too, so a vector that a third of all rows
share costs no more than any other. Everything later works on this table.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clauseforge.errors import EmptySideError
from clauseforge.functions.masks import half_columns, one_columns
from clauseforge.functions.predicates import feature_array, feature_column, is_feature_set
from clauseforge.operators import blocks
from clauseforge.operators.blocks import packed_batch
from clauseforge.operators.pairs import pair_work
from clauseforge.storage import discard, keep_table

# Packing travels inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(blocks)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONFLICT_CHOICES = ("error", "drop")
# Pair-literal products one task should get before a second task is worth it.
TASK_WORK = 1 << 28
LONG_TASK_WORK = 1 << 37
TASK_BYTES = 128 << 20


def split_by_label(df: DataFrame, label: str = "label", features: str = "features"):
    """``(positives, negatives)``, each with the feature column only."""
    return (
        df.filter(F.col(label) == 1).select(features),
        df.filter(F.col(label) == 0).select(features),
    )


def union_sides(positive: DataFrame, negative: DataFrame, features: str = "features") -> DataFrame:
    """One table with a ``label`` column from a positive and a negative set."""

    alike = positive.schema[features].dataType == negative.schema[features].dataType
    column = feature_column if alike else feature_array

    def side(df: DataFrame, label: int) -> DataFrame:
        return df.select(F.lit(label).alias("label"), column(df, features).alias("features"))

    return side(positive, 1).unionByName(side(negative, 0))


def register_sides(df: DataFrame, positive: str = "positive", negative: str = "negative") -> None:
    """Make both sides available to SQL under the given view names."""
    left, right = split_by_label(df)
    left.createOrReplaceTempView(positive)
    right.createOrReplaceTempView(negative)


def side_emptiness(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, empty)`` of both sides; a side is read up to its first row."""

    def side(value: int) -> DataFrame:
        first = df.filter(F.col(label) == value).select(F.lit(value).alias("label")).limit(1)
        return first.agg(F.lit(value).alias("label"), (F.count(F.lit(1)) == 0).alias("empty"))

    return side(1).unionByName(side(0))


def vector_width(df: DataFrame, features: str = "features") -> int | None:
    """Length of the first vector, or None for an empty table."""
    size = F.col(features)["size"] if is_feature_set(df, features) else F.size(feature_array(df, features))
    row = df.select(size.alias("n")).head()
    return None if row is None else row["n"]


def pack(df: DataFrame, width: int, features: str = "features", keep: list[str] | None = None) -> DataFrame:
    """Feature vectors as word columns; a vector of another width or value is an error.

    Array functions would take one interpreted call per feature; packing whole
    Arrow batches is several times faster, and its output is n/8 bytes a row. A
    sparse vector or a set of active features goes from its indices to words.
    """
    kept = list(keep or [])
    rows = df.select(*kept, feature_column(df, features).alias("__features"))
    fields = [rows.schema[c] for c in kept] + [
        StructField(c, LongType()) for c in one_columns(width) + half_columns(width)
    ]

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                yield packed_batch(batch, width, len(kept))

    return rows.mapInArrow(task, StructType(fields))


def distinct_vectors(df: DataFrame, width: int, label: str = "label", features: str = "features") -> DataFrame:
    """``(w*, half, pos, neg)``, one row per distinct vector; a label other than 0 or 1 is an error."""
    wrong = F.raise_error(F.lit(f"a value of {label} is not 0 or 1")).cast("int")
    checked = F.when(F.col(label).isin(0, 1), F.col(label).cast("int")).otherwise(wrong)
    labelled = df.select(checked.alias(label), features)
    packed = pack(labelled, width, features, keep=[label])
    uncertain = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in half_columns(width)])
    half = F.when(uncertain, F.array(*half_columns(width))).alias("half")
    return packed.select(label, *one_columns(width), half).groupBy(*one_columns(width), "half").agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
        F.sum((F.col(label) == 0).cast("bigint")).alias("neg"),
    )


def with_half_columns(distinct: DataFrame, width: int) -> DataFrame:
    """``(w*, h*, pos, neg)``."""
    halves = [
        F.coalesce(F.get("half", F.lit(i)), F.lit(0)).alias(c)
        for i, c in enumerate(half_columns(width))
    ]
    return distinct.select(*one_columns(width), *halves, "pos", "neg")


def conflicting_vectors(distinct: DataFrame) -> DataFrame:
    """The vectors that carry both labels."""
    return distinct.filter((F.col("pos") > 0) & (F.col("neg") > 0))


@dataclass(frozen=True)
class Instances:
    """Distinct vectors with the totals a learner plans with."""

    df: DataFrame
    width: int
    halves: bool
    positives: int
    negatives: int
    positive_vectors: int
    negative_vectors: int
    tasks: int = 1
    parents: tuple[DataFrame, ...] = ()
    path: str | None = None

    def side(self, which: str) -> DataFrame:
        """``(w*, [h*], mult)`` of one side, ``"pos"`` or ``"neg"``."""
        words = one_columns(self.width) + (half_columns(self.width) if self.halves else [])
        return self.df.filter(F.col(which) > 0).select(*words, F.col(which).alias("mult"))

    @property
    def row_bytes(self) -> int:
        """Size of one packed row: its words, its multiplicity and its flag."""
        words = len(one_columns(self.width)) * (2 if self.halves else 1)
        return 8 * words + 9

    def release(self) -> None:
        """Let go of memory, and delete the stored table."""
        for df in (self.df, *self.parents):
            df.unpersist()
        if self.path:
            discard(self.df.sparkSession, self.path)


def gather_instances(
    df: DataFrame,
    label: str = "label",
    features: str = "features",
    on_conflict: str = "error",
    partitions: int | None = None,
    durable: bool = True,
    cache: bool = True,
    width: int | None = None,
) -> Instances:
    """Pack and count ``df`` once, keep the result, and take its totals.

    ``on_conflict="drop"`` leaves out vectors that carry both labels. With
    ``durable`` the distinct table is stored in the shared folder, so losing an
    executor later costs a file read and not the scan and shuffle. Naming the
    ``width`` saves the look at the first row, which is a job of its own.
    """
    if on_conflict not in CONFLICT_CHOICES:
        raise ValueError(f"on_conflict must be one of {CONFLICT_CHOICES}")
    width = width or vector_width(df, features)
    if not width:
        raise EmptySideError("the instance table is empty" if width is None else "the vectors are empty")
    distinct = distinct_vectors(df, width, label, features)
    if on_conflict == "drop":
        distinct = distinct.filter((F.col("pos") == 0) | (F.col("neg") == 0))
    path = None
    if durable:
        distinct, path = keep_table(distinct, "vectors")
    elif cache:
        distinct = distinct.persist(StorageLevel.MEMORY_AND_DISK)
    kept, distinct = distinct, with_half_columns(distinct, width)
    found = _with_totals(distinct, width)
    spread = partitions or _tasks(found, df.sparkSession.sparkContext.defaultParallelism)
    # The rows are few bytes but many pairs each: an explicit number keeps AQE
    # from merging them by size into fewer tasks than the work needs.
    spaced = distinct.repartition(spread, *one_columns(width))
    if cache:
        spaced = spaced.persist(StorageLevel.MEMORY_AND_DISK)
    return replace(
        found, df=spaced, tasks=spread, parents=() if durable or not cache else (kept,), path=path
    )


def _tasks(found: Instances, parallelism: int) -> int:
    """As many tasks as the pair work of a full step fills, one per core at first,
    and as the bytes and long work need, whatever number of cores there is now."""
    rows = found.positive_vectors + found.negative_vectors
    work = pair_work(found.positive_vectors, found.negative_vectors, found.width)
    filled = min(parallelism, math.ceil(work / TASK_WORK))
    by_size = math.ceil(rows * found.row_bytes / TASK_BYTES)
    return max(1, filled, min(rows, math.ceil(work / LONG_TASK_WORK)), by_size)


def _with_totals(distinct: DataFrame, width: int) -> Instances:
    def number(test: Column, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, what).otherwise(0)), F.lit(0)).cast("bigint")

    any_half = F.greatest(*[(F.col(c) != 0).cast("int") for c in half_columns(width)], F.lit(0))
    row = distinct.agg(
        number(F.lit(True), F.col("pos")).alias("p"),
        number(F.lit(True), F.col("neg")).alias("q"),
        number(F.col("pos") > 0, F.lit(1)).alias("p_rows"),
        number(F.col("neg") > 0, F.lit(1)).alias("q_rows"),
        F.coalesce(F.max(any_half), F.lit(0)).alias("halves"),
    ).head()
    if row["p"] == 0:
        raise EmptySideError("the positive side is empty")
    if row["q"] == 0:
        raise EmptySideError("the negative side is empty")
    return Instances(
        distinct, width, bool(row["halves"]), row["p"], row["q"], row["p_rows"], row["q_rows"]
    )
