"""Distances of single vectors, stored once and used for many sets of survivors.

A histogram tells how many positives lie at each distance from a distinct negative
vector. With it the pairs of any surviving negatives with all positives are a sum
over rows; what the positives that are gone had with them is subtracted, so only
those pairs are looked at again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseforge.functions.masks import Mask, half_columns, one_columns
from clauseforge.operators.instances import Instances
from clauseforge.operators.pairs import BROADCAST_LIMIT, distance_tally, histogram_tally
from clauseforge.operators.relevance import sides
from clauseforge.storage import discard, keep_table


@dataclass(frozen=True)
class Histograms:
    """``(w*, [h*], mult, d, positives)``: at most n + 1 rows for each distinct negative vector."""

    df: DataFrame
    instances: Instances
    path: str

    def release(self) -> None:
        """Delete the stored table; the instances stay."""
        discard(self.df.sparkSession, self.path)

    def pairs(self, test: Column | None = None) -> DataFrame:
        """``(d, pairs)`` of all positives with the negatives that pass ``test``."""
        rows = self.df if test is None else self.df.filter(test)
        each = F.col("mult").cast("decimal(19,0)") * F.col("positives")
        return rows.groupBy("d").agg(F.sum(each).cast("decimal(38,0)").alias("pairs"))


def distance_histograms(instances: Instances, limit: int = BROADCAST_LIMIT) -> Histograms:
    """Every positive against every negative once, in a grid of bounded blocks, stored by negative."""
    pos, neg = sides(instances, "cross", limit)
    everything = Mask.empty(instances.width)
    rows = histogram_tally(pos.pick(everything), neg.pick(everything))
    words = one_columns(instances.width) + (half_columns(instances.width) if instances.halves else [])
    merged = rows.groupBy(*words, "mult", "d").agg(F.sum("positives").alias("positives"))
    df, path = keep_table(merged, "histograms")
    return Histograms(df, instances, path)


def vectors_by(instances: Instances, test: Column) -> tuple[int, int]:
    """Distinct positive vectors that pass ``test``, and those that do not."""
    positive = F.col("pos") > 0
    row = instances.df.agg(F.count_if(positive & test), F.count_if(positive & ~test)).head()
    return row[0], row[1]


def distances_meeting(
    histograms: Histograms, term: dict[int, int], strategy: str = "auto", limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """``(d, pairs)`` of the rows of both sides that meet ``term`` exactly.

    The pairs looked at are those of the surviving negatives with the positives
    that are gone or with those that survive, whichever are fewer vectors.
    """
    instances = histograms.instances
    keep = Mask.of(term, instances.width)
    test = keep.exact(instances.halves)
    kept, gone = vectors_by(instances, test)
    pos, neg = sides(instances, strategy, limit)
    if kept <= gone:
        return _counted(distance_tally(pos.pick(keep), neg.pick(keep), instances.width))
    lost = _counted(distance_tally(pos.missing(keep), neg.pick(keep), instances.width))
    return _less(histograms.pairs(test), lost)


def distances_uncovered(
    histograms: Histograms, term: dict[int, int], strategy: str = "auto", limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """``(d, pairs)`` of the positives that ``term`` does not cover with all negatives."""
    instances = histograms.instances
    cover = Mask.of(term, instances.width)
    covered, left = vectors_by(instances, cover.allows(instances.halves))
    pos, neg = sides(instances, strategy, limit)
    everything = neg.pick(Mask.empty(instances.width))
    if left <= covered:
        return _counted(distance_tally(pos.uncovered(cover), everything, instances.width))
    lost = _counted(distance_tally(pos.covered(cover), everything, instances.width))
    return _less(histograms.pairs(), lost)


def _counted(partials: DataFrame) -> DataFrame:
    found = partials.filter("key >= 0").groupBy(F.col("key").alias("d"))
    return found.agg(F.sum("r").cast("decimal(38,0)").alias("pairs")).filter("pairs > 0")


def _less(all_pairs: DataFrame, lost: DataFrame) -> DataFrame:
    gone = lost.select("d", (-F.col("pairs")).cast("decimal(38,0)").alias("pairs"))
    both = all_pairs.unionByName(gone).groupBy("d")
    return both.agg(F.sum("pairs").cast("decimal(38,0)").alias("pairs")).filter("pairs > 0")
