"""Pair distances and literal relevance as DataFrames.

The relevance of a literal is the sum, over pairs of a positive and a negative
it tells apart, of 1 / (number of features the two differ in), in whole numbers
of 2**-36.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.functions.masks import Mask
from clauseforge.functions.predicates import split_literal
from clauseforge.operators.blocks import FINE_BITS, FINE_ROWS, UNIT_BITS, Rule
from clauseforge.operators.instances import Instances
from clauseforge.operators.pairs import (
    BROADCAST_LIMIT,
    TOTALS,
    ArraySide,
    TableSide,
    array_side,
    choose_strategy,
    coefficient_tally,
    distance_tally,
    empty_keys,
    merged,
    pair_tally,
)


def sides(
    instances: Instances,
    strategy: str = "auto",
    limit: int = BROADCAST_LIMIT,
    positive_partitions: int | None = None,
    negative_partitions: int | None = None,
) -> tuple[ArraySide | TableSide, ArraySide | TableSide]:
    """Both sides in the form the strategy needs."""
    chosen = choose_strategy(
        strategy,
        instances.positive_vectors,
        instances.negative_vectors,
        instances.row_bytes,
        limit,
    )

    def side(which: str, vectors: int, fetched: bool, partitions: int | None):
        df = instances.side(which)
        if fetched:
            return array_side(df, instances.width, instances.halves)
        tasks = instances.tasks
        if partitions and partitions > 0 and partitions != tasks:
            df, tasks = df.repartition(partitions).persist(), partitions
        return TableSide(df, instances.width, instances.halves, vectors, tasks, block_rows)

    block_rows = max(1, limit // instances.row_bytes)
    return (
        side("pos", instances.positive_vectors, chosen == "broadcast_positive", positive_partitions),
        side("neg", instances.negative_vectors, chosen == "broadcast_negative", negative_partitions),
    )


def rule_for(instances: Instances, halves: str | None = "weighted") -> Rule:
    rows = instances.positives + instances.negatives
    return Rule(instances.width, halves if instances.halves else None, rows)


def relevance(
    instances: Instances,
    strategy: str = "auto",
    term: dict[int, int] | None = None,
    limit: int = BROADCAST_LIMIT,
    halves: str = "weighted",
) -> DataFrame:
    """``(lit, r)`` for every literal, over the rows that meet ``term`` exactly."""
    pos, neg = sides(instances, strategy, limit)
    mask = Mask.of(term or {}, instances.width)
    rule = rule_for(instances, halves)
    if term and rule.halves == "weighted":
        counts = survivor_counts(instances, term).head()
        rule = replace(rule, rows=counts["p"] + counts["q"])
    partials, _ = pair_tally(pos.pick(mask), neg.pick(mask), rule)
    return _by_literal(instances, partials)


def _by_literal(instances: Instances, partials: DataFrame) -> DataFrame:
    spark = instances.df.sparkSession
    literals = F.col("key").between(0, 2 * instances.width - 1)
    rows = merged(partials.filter(literals).unionByName(empty_keys(spark, 2 * instances.width)))
    return rows.select(F.col("key").alias("lit"), "r")


def relevance_after(
    instances: Instances,
    before: DataFrame,
    literal: int,
    term: dict[int, int] | None = None,
    strategy: str = "auto",
    limit: int = BROADCAST_LIMIT,
    halves: str = "weighted",
) -> DataFrame:
    """``(lit, r)`` after one more literal, from the relevance ``before`` it.

    The pairs that are lost are those with an erased row on either side, so
    R(kept x kept) = R(all x all) - R(pairs with an erased row). Cheaper than
    starting over while fewer than half of the pairs are lost.

    Where uncertain values add relevance, their weight u changes with the rows that
    are left. ``before`` may then be the coefficients of u
    (:func:`relevance_coefficients`), which subtract exactly whatever u is. A
    ``before`` that is (lit, r) serves while more than 64 rows are left, as r does not
    depend on u then; fewer rows are few pairs, which are summed anew.
    """
    feature, want = split_literal(literal, instances.width)
    after = {**(term or {}), feature: want}
    rule = Rule(instances.width, halves if instances.halves else None)
    if rule.halves == "weighted":
        left = survivor_counts(instances, after).head()
        rows = left["p"] + left["q"]
        if "certain" in before.columns:
            kept = coefficients_after(instances, before, literal, term, strategy, limit)
            return relevance_of(kept, instances.width, rows)
        if rows <= FINE_ROWS:
            return relevance(instances, strategy, after, limit)
        rule = replace(rule, rows=rows)
    pos, neg = _erased_by(instances, literal, term, strategy, limit)
    lost = _by_literal(instances, pair_tally(pos, neg, rule)[0])
    return _added(before.select("lit", F.col("r").cast("decimal(38,0)")), lost, ["lit"], ["r"])


def _erased_by(instances: Instances, literal: int, term: dict[int, int] | None, strategy: str, limit: int):
    """Both sides where ``term`` is met, the rows that ``literal`` erases flagged."""
    feature, want = split_literal(literal, instances.width)
    keep = Mask.of(term or {}, instances.width)
    chosen = Mask.of({feature: want}, instances.width)
    pos, neg = sides(instances, strategy, limit)
    return pos.pick(keep, chosen), neg.pick(keep, chosen)


def _added(before: DataFrame, lost: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """``before`` less ``lost``, by key."""
    less = lost.select(*keys, *[(-F.col(c)).cast("decimal(38,0)").alias(c) for c in sums])
    both = before.select(*keys, *sums).unionByName(less)
    return both.groupBy(*keys).agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in sums])


# Relevance as coefficients of the weight of an uncertain value


COEFFICIENT_KEYS = ["lit", "certain", "unsure"]


def relevance_coefficients(
    instances: Instances,
    strategy: str = "auto",
    term: dict[int, int] | None = None,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """``(lit, certain, unsure, full, part)`` over the rows that meet ``term`` exactly.

    With u the weight of an uncertain value, the relevance of a literal is the sum of
    (full + u part / 2) / (certain + u unsure) over its rows. The whole numbers full
    and part do not depend on u. There are at most 2n rows for each pair of numbers
    of certain and uncertain differences, whatever the size of the data.
    """
    pos, neg = sides(instances, strategy, limit)
    mask = Mask.of(term or {}, instances.width)
    partials = coefficient_tally(pos.pick(mask), neg.pick(mask), instances.width)
    return partials.groupBy(*COEFFICIENT_KEYS).agg(
        *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("full", "part")]
    )


def coefficients_after(
    instances: Instances,
    before: DataFrame,
    literal: int,
    term: dict[int, int] | None = None,
    strategy: str = "auto",
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """The coefficients after one more literal, from those ``before`` it and the pairs lost."""
    pos, neg = _erased_by(instances, literal, term, strategy, limit)
    lost = coefficient_tally(pos, neg, instances.width)
    left = _added(before, lost, COEFFICIENT_KEYS, ["full", "part"])
    return left.where("full <> 0 OR part <> 0")


def relevance_of(coefficients: DataFrame, width: int, rows: int) -> DataFrame:
    """``(lit, r)`` for ``rows`` rows on both sides, in the units of :func:`relevance`."""

    def weigh(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            found = [
                Decimal(coefficient_units(int(c), int(m), int(full), int(part), rows))
                for c, m, full, part in zip(batch.certain, batch.unsure, batch.full, batch.part)
            ]
            yield pd.DataFrame({"lit": batch.lit, "r": found})

    spark = coefficients.sparkSession
    weighed = coefficients.mapInPandas(weigh, "lit int, r decimal(38,0)")
    none = empty_keys(spark, 2 * width).select(F.col("key").alias("lit"), "r")
    return weighed.unionByName(none).groupBy("lit").agg(F.sum("r").cast("decimal(38,0)").alias("r"))


def coefficient_units(certain: int, unsure: int, full: int, part: int, rows: int) -> int:
    """Units of (full + u part / 2) / (certain + u unsure): exact u for few rows, else its limit."""
    if rows <= FINE_ROWS:
        one = 1 << rows  # 1 / u
        above, below = 2 * full * one + part, 2 * (certain * one + unsure)
        return ((above << (FINE_BITS + 1)) + below) // (2 * below) if below else 0
    if certain:
        return full * _rounded(1 << UNIT_BITS, certain)
    return part * _rounded(1 << (UNIT_BITS - 1), unsure) if unsure else 0


def _rounded(above: int, below: int) -> int:
    """above / below, halves to the even side as doubles are."""
    whole, rest = divmod(above, below)
    return whole + (2 * rest > below or (2 * rest == below and whole % 2))


def top_literal(relevances: DataFrame) -> DataFrame:
    """``(lit, r)`` of the most relevant literal; the lowest index wins a tie."""
    best = F.max(F.struct("r", (-F.col("lit")).alias("order"), "lit")).alias("best")
    return relevances.agg(best).select("best.lit", "best.r")


def pair_distances(
    instances: Instances,
    strategy: str = "auto",
    term: dict[int, int] | None = None,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """``(d, pairs)``: positive/negative pairs at each number of differing features."""
    pos, neg = sides(instances, strategy, limit)
    mask = Mask.of(term or {}, instances.width)
    partials = distance_tally(pos.pick(mask), neg.pick(mask), instances.width)
    return (
        partials.filter(F.col("key") != TOTALS)
        .groupBy(F.col("key").alias("d"))
        .agg(F.sum("r").cast("decimal(38,0)").alias("pairs"))
        .filter(F.col("pairs") > 0)
    )


def survivor_counts(instances: Instances, term: dict[int, int]) -> DataFrame:
    """``(p, q)``: positives and negatives that meet ``term`` exactly."""
    kept = instances.df.filter(Mask.of(term, instances.width).exact(halves=True))
    return kept.agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("q")
    )
