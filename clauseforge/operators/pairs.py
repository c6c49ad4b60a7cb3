"""Positives against negatives, without a row per pair.

While the smaller side is below a byte limit it is broadcast, and the rows of the
other stream past it where they lie, without a shuffle.

Beyond the limit both sides become block tables: one row holds a few thousand
packed vectors as binary. Blocks are dealt to R and C groups, and cell (r, c) of a
grid is one task's meeting of group r with group c, so a block is copied once per
group of the other side and no vector passes through the driver. A step is one
job, whatever the sizes.

A cell or task reduces its pairs to one number per literal; these are added up
within each task first, then by literal across tasks.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.functions.masks import Mask, half_columns, one_columns
from clauseforge.operators import blocks
from clauseforge.operators.blocks import (
    Block,
    Rule,
    block_from_arrow,
    coefficient_counts,
    distance_counts,
    distance_rows,
    literal_counts,
    relevance_sum,
)

# The block arithmetic travels inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(blocks)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRATEGIES = ("auto", "broadcast_positive", "broadcast_negative", "cross")
BROADCAST_LIMIT = 64 * 1024 * 1024
TALLY_SCHEMA = "key int, r decimal(38,0), pos bigint, neg bigint"
COEFFICIENT_SCHEMA = "lit int, certain int, unsure int, full decimal(38,0), part decimal(38,0)"
BLOCK_SCHEMA = "first int, n int, ones binary, halves binary, mult binary, flag binary"
# Two blocks of this many vectors are some ten seconds of work for a core.
BLOCK_ROWS = 1 << 15
# Cells for each core there is now, so that tasks of uneven work even out.
CELLS_PER_CORE = 4
# Pair-literal products for which a cell on a core of its own is worth it, and
# for which one more task is, whatever number of cores there is.
CELL_WORK = 1 << 28
LONG_CELL_WORK = 1 << 36
# Of more literals than this, hardly any pair of blocks has more in use.
WORK_LITERALS = 1 << 8
# Partial rows the driver may add up itself; more are merged in Spark.
DRIVER_ROWS = 1 << 16
# The key under which the flagged rows of each side are counted.
TOTALS = -1


@dataclass
class TableSide:
    """A side that stays distributed: ``(w*, [h*], mult)``, in ``tasks`` partitions."""

    df: DataFrame
    width: int
    halves: bool
    vectors: int
    tasks: int
    # Vectors of this side that one block may hold.
    block_rows: int = 1 << 14

    def pick(self, keep: Mask, erased_by: Mask | None = None) -> TableSide:
        """Rows that meet ``keep``; flagged are all of them, or those ``erased_by`` drops."""
        flag = F.lit(True) if erased_by is None else ~erased_by.exact(self.halves)
        rows = self.df.filter(keep.exact(self.halves)).withColumn("flag", flag)
        return replace(self, df=rows)

    def missing(self, keep: Mask) -> TableSide:
        """The rows that :meth:`pick` leaves out."""
        rows = self.df.filter(~keep.exact(self.halves)).withColumn("flag", F.lit(True))
        return replace(self, df=rows)

    def marked(self, term: Mask) -> TableSide:
        """All rows, those flagged that ``term`` covers."""
        return replace(self, df=self.df.withColumn("flag", term.allows(self.halves)))

    def covered(self, term: Mask) -> TableSide:
        rows = self.df.filter(term.allows(self.halves)).withColumn("flag", F.lit(True))
        return replace(self, df=rows)

    def uncovered(self, term: Mask) -> TableSide:
        rows = self.df.filter(~term.allows(self.halves))
        return replace(self, df=rows)


@dataclass
class ArraySide:
    """A side small enough to broadcast, held as word arrays."""

    block: Block
    width: int

    @property
    def vectors(self) -> int:
        return len(self.block)

    def pick(self, keep: Mask, erased_by: Mask | None = None) -> ArraySide:
        rows = self.block.take(keep.exact_rows(self.block.ones, self.block.halves))
        if erased_by is None:
            flag = np.ones(len(rows), dtype=bool)
        else:
            flag = ~erased_by.exact_rows(rows.ones, rows.halves)
        return ArraySide(rows.flagged(flag), self.width)

    def missing(self, keep: Mask) -> ArraySide:
        rows = self.block.take(~keep.exact_rows(self.block.ones, self.block.halves))
        return ArraySide(rows.flagged(np.ones(len(rows), dtype=bool)), self.width)

    def marked(self, term: Mask) -> ArraySide:
        flag = term.allows_rows(self.block.ones, self.block.halves)
        return ArraySide(self.block.flagged(flag), self.width)

    def covered(self, term: Mask) -> ArraySide:
        rows = self.block.take(term.allows_rows(self.block.ones, self.block.halves))
        return ArraySide(rows.flagged(np.ones(len(rows), dtype=bool)), self.width)

    def uncovered(self, term: Mask) -> ArraySide:
        return ArraySide(
            self.block.take(~term.allows_rows(self.block.ones, self.block.halves)), self.width
        )

    def flagged_counts(self) -> tuple[np.ndarray, int]:
        rows = self.block.take(self.block.flag)
        return literal_counts(rows, self.width), int(rows.mult.sum())


def choose_strategy(
    strategy: str, positive_vectors: int, negative_vectors: int, row_bytes: int, limit: int
) -> str:
    """The form to run. Sides that would pass ``limit`` as a broadcast meet in a grid of blocks."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    fits = {
        "broadcast_positive": positive_vectors * row_bytes <= limit,
        "broadcast_negative": negative_vectors * row_bytes <= limit,
        "cross": True,
    }
    if strategy == "auto":
        strategy = (
            "broadcast_positive" if positive_vectors <= negative_vectors else "broadcast_negative"
        )
    return strategy if fits[strategy] else "cross"


def array_side(df: DataFrame, width: int, halves: bool) -> ArraySide:
    """Fetch a side whose size has been checked."""
    return ArraySide(block_from_arrow(df.toArrow(), width, halves), width)


def pair_tally(pos, neg, rule: Rule) -> tuple[DataFrame, object]:
    """``(key, r, pos, neg)`` partial rows over pairs with a flagged row.

    ``r`` sums relevance units per literal, then second sums if the rule has
    them; ``pos`` and ``neg`` count the flagged rows that meet the literal, on
    the sides that are distributed. Also returns the broadcast to destroy after
    the job, if there is one.
    """
    return partial_rows(pos, neg, _RelevanceKernel(rule))


@dataclass(frozen=True)
class Node:
    """Pairs of the rows that meet a conjunction; of the positives the flagged ones, or the others."""

    mask: Mask
    flagged: bool

    def of(self, block: Block, positive: bool) -> Block:
        keep = self.mask.exact_rows(block.ones, block.halves)
        if positive:
            keep &= block.flag == self.flagged
        rows = block.take(keep)
        return rows.flagged(np.ones(len(rows), dtype=bool))


def node_tally(pos, neg, rule: Rule, nodes: list[Node]) -> tuple[DataFrame, object]:
    """:func:`pair_tally` for several conjunctions in one pass; node i has the keys from ``i * rule.sums``."""
    return partial_rows(pos, neg, _NodesKernel(rule, tuple(nodes)))


def distance_tally(pos, neg, width: int) -> DataFrame:
    """``(key, r)`` partial rows: pairs with a flagged row at each distance."""
    return partial_rows(pos, neg, _DistanceKernel(width))[0].select("key", "r")


def histogram_tally(pos: TableSide, neg: TableSide) -> DataFrame:
    """``(w*, [h*], mult, d, positives)`` of the negative vectors; a vector has rows from several cells."""
    return _in_grid(pos, neg, _HistogramKernel(pos.width, pos.halves))


def coefficient_tally(pos, neg, width: int) -> DataFrame:
    """``(lit, certain, unsure, full, part)`` partial rows over pairs with a flagged row."""
    return partial_rows(pos, neg, _CoefficientKernel(width))[0]


def partial_rows(pos, neg, kernel):
    """The kernel's rows, one set per task or cell, and the broadcast to destroy, if any."""
    if isinstance(pos, ArraySide) and isinstance(neg, ArraySide):
        raise ValueError("at least one side has to be distributed")
    if isinstance(pos, ArraySide):
        return _against_broadcast(neg, pos, kernel, small_is_positive=True)
    if isinstance(neg, ArraySide):
        return _against_broadcast(pos, neg, kernel, small_is_positive=False)
    return _in_grid(pos, neg, kernel), None


class Kernel:
    """What two blocks add up to: ``keys`` whole numbers and counts of flagged rows."""

    schema = TALLY_SCHEMA

    def zero(self):
        return 0

    def counts(self, block: Block, positive: bool):
        return np.zeros(self.keys, dtype=np.int64), 0

    def rows(self, sums, pos_counts, neg_counts) -> pa.RecordBatch:
        keys = np.append(np.arange(self.keys, dtype=np.int32), np.int32(TOTALS))
        values = sums if isinstance(sums, np.ndarray) else np.zeros(self.keys, dtype=object)

        def counted(counts) -> pa.Array:
            per_key, total = counts
            return pa.array(np.append(per_key, total), pa.int64())

        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int32()),
                pa.array([Decimal(int(x)) for x in values] + [Decimal(0)], pa.decimal128(38, 0)),
                counted(pos_counts),
                counted(neg_counts),
            ],
            names=["key", "r", "pos", "neg"],
        )


@dataclass(frozen=True)
class _RelevanceKernel(Kernel):
    rule: Rule

    @property
    def width(self) -> int:
        return self.rule.width

    @property
    def keys(self) -> int:
        return self.rule.sums

    def sums(self, pos: Block, neg: Block):
        return relevance_sum(pos, neg, self.rule)

    def counts(self, block: Block, positive: bool):
        rows = block.take(block.flag)
        none = np.zeros(self.keys - 2 * self.width, dtype=np.int64)
        return np.append(literal_counts(rows, self.width), none), int(rows.mult.sum())


@dataclass(frozen=True)
class _NodesKernel(Kernel):
    rule: Rule
    nodes: tuple[Node, ...]

    @property
    def keys(self) -> int:
        return len(self.nodes) * self.rule.sums

    def sums(self, pos: Block, neg: Block):
        return np.concatenate(
            [relevance_sum(n.of(pos, True), n.of(neg, False), self.rule) for n in self.nodes]
        )

    def counts(self, block: Block, positive: bool):
        one = _RelevanceKernel(self.rule)
        found = [one.counts(n.of(block, positive), positive) for n in self.nodes]
        return np.concatenate([f[0] for f in found]), sum(f[1] for f in found)


@dataclass(frozen=True)
class _DistanceKernel(Kernel):
    width: int

    @property
    def keys(self) -> int:
        return self.width + 1

    def sums(self, pos: Block, neg: Block):
        return distance_counts(pos, neg, self.width)


@dataclass(frozen=True)
class _CoefficientKernel(Kernel):
    width: int
    schema = COEFFICIENT_SCHEMA
    keys = 0

    def zero(self):
        return Counter()

    def sums(self, pos: Block, neg: Block):
        return coefficient_counts(pos, neg, self.width)

    def rows(self, sums, pos_counts, neg_counts) -> pa.RecordBatch:
        keys = sorted({key[:3] for key in sums})
        columns = [pa.array([key[i] for key in keys], pa.int32()) for i in range(3)]
        columns += [
            pa.array([Decimal(sums[(*key, name)]) for key in keys], pa.decimal128(38, 0))
            for name in ("full", "part")
        ]
        return pa.RecordBatch.from_arrays(columns, names=["lit", "certain", "unsure", "full", "part"])


@dataclass(frozen=True)
class _HistogramKernel(Kernel):
    """Rows of single negative vectors, for cells of bounded blocks only."""

    width: int
    halves: bool
    keys = 0

    @property
    def columns(self) -> list[str]:
        return one_columns(self.width) + (half_columns(self.width) if self.halves else [])

    @property
    def schema(self) -> str:
        return ", ".join(f"{c} bigint" for c in self.columns) + ", mult bigint, d int, positives bigint"

    def zero(self):
        return []

    def sums(self, pos: Block, neg: Block):
        return [(neg, distance_rows(pos, neg, self.width))]

    def rows(self, sums, pos_counts, neg_counts) -> pa.RecordBatch:
        ((neg, counts),) = sums
        row, d = np.nonzero(counts)
        words = np.hstack([neg.ones, neg.halves]) if self.halves else neg.ones
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(words[row, i]), pa.int64()) for i in range(len(self.columns))]
            + [
                pa.array(neg.mult[row], pa.int64()), pa.array(d, pa.int32()),
                pa.array(counts[row, d], pa.int64()),
            ],
            names=[*self.columns, "mult", "d", "positives"],
        )


def _nothing(kernel):
    return np.zeros(kernel.keys, dtype=np.int64), 0


def _against_broadcast(big: TableSide, small: ArraySide, kernel, small_is_positive: bool):
    held_rows = (small.block.ones, small.block.halves, small.block.mult, small.block.flag)
    sent = big.df.sparkSession.sparkContext.broadcast(held_rows)
    width, halves = big.width, big.halves

    def task(batches):
        held = Block(*sent.value)
        sums, counts, seen = kernel.zero(), _nothing(kernel), False
        for rows in _joined(batches, width, halves):
            seen = True
            sums = sums + (kernel.sums(held, rows) if small_is_positive else kernel.sums(rows, held))
            here = kernel.counts(rows, not small_is_positive)
            counts = (counts[0] + here[0], counts[1] + here[1])
        if seen:
            nothing = _nothing(kernel)
            sides = (nothing, counts) if small_is_positive else (counts, nothing)
            yield kernel.rows(sums, *sides)

    return big.df.mapInArrow(task, kernel.schema), sent


def _joined(batches, width: int, halves: bool) -> Iterator[Block]:
    """The rows of batches as blocks of some ``BLOCK_ROWS``: what is sent is prepared for each of them."""
    pending = None
    for batch in batches:
        if batch.num_rows:
            block = block_from_arrow(batch, width, halves)
            pending = block if pending is None else pending.joined(block)
            if len(pending) >= BLOCK_ROWS:
                yield pending
                pending = None
    if pending is not None:
        yield pending


# Both sides large


@dataclass(frozen=True)
class Grid:
    """How two sides of block tables meet."""

    pos_rows: int
    neg_rows: int
    pos_groups: int
    neg_groups: int
    tasks: int


def pair_work(pos_vectors: int, neg_vectors: int, width: int) -> int:
    """Pair-literal products of two sides."""
    return pos_vectors * neg_vectors * min(2 * width, WORK_LITERALS)


def grid_of(pos_vectors: int, neg_vectors: int, most: tuple[int, int], width: int, cores: int) -> Grid:
    """Blocks so large that cells are few and so small that every core gets several.

    ``most`` is the number of vectors a block of either side may hold. Little work
    is one cell; much work is more tasks than there are cores now.
    """
    work = pair_work(pos_vectors, neg_vectors, width)
    wanted = max(1, min(CELLS_PER_CORE * cores, math.ceil(work / CELL_WORK)))
    even = math.isqrt(max(1, pos_vectors * neg_vectors // wanted))
    rows = [min(max(even, blocks.TILE), BLOCK_ROWS, max(1, m)) for m in most]
    groups = [max(1, math.ceil(n / r)) for n, r in zip((pos_vectors, neg_vectors), rows)]
    tasks = min(groups[0] * groups[1], max(wanted, math.ceil(work / LONG_CELL_WORK)))
    return Grid(*rows, *groups, tasks)


def block_table(side: TableSide, rows: int) -> DataFrame:
    """The side's vectors ``rows`` at a time, packed where they lie: ``(first, n, ones, halves, mult, flag)``.

    ``first`` numbers the blocks of all tasks without gaps while they are full, which
    deals them evenly to any number of groups.
    """
    width, halves, tasks = side.width, side.halves, side.tasks

    def task(batches):
        from pyspark import TaskContext

        number, pending = TaskContext.get().partitionId(), None
        for batch in batches:
            if batch.num_rows:
                block = block_from_arrow(batch, width, halves)
                pending = block if pending is None else pending.joined(block)
            while pending is not None and len(pending) >= rows:
                yield _block_row(pending.take(slice(0, rows)), number)
                pending, number = pending.take(slice(rows, None)), number + tasks
        if pending is not None and len(pending):
            yield _block_row(pending, number)

    return side.df.mapInArrow(task, BLOCK_SCHEMA)


def _block_row(block: Block, number: int) -> pa.RecordBatch:
    halves = None if block.halves is None else np.ascontiguousarray(block.halves).tobytes()
    values = [np.ascontiguousarray(x).tobytes() for x in (block.ones, block.mult, block.flag)]
    binary = [values[0], halves, values[1], values[2]]
    columns = [pa.array([number % (1 << 31)], pa.int32()), pa.array([len(block)], pa.int32())]
    columns += [pa.array([b], pa.binary()) for b in binary]
    return pa.RecordBatch.from_arrays(columns, names=["first", "n", "ones", "halves", "mult", "flag"])


def _block_of(table: pa.Table, width: int, halves: bool) -> Block:
    """All block rows of one group as one block."""

    def whole(name: str, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)

    words = -(-width // 64)
    return Block(
        whole("ones", np.int64).reshape(-1, words),
        whole("halves", np.int64).reshape(-1, words) if halves else None,
        whole("mult", np.int64),
        whole("flag", bool),
    )


def _in_grid(pos: TableSide, neg: TableSide, kernel) -> DataFrame:
    """Both sides distributed: every block of one meets every block of the other in some cell."""
    cores = pos.df.sparkSession.sparkContext.defaultParallelism
    grid = grid_of(pos.vectors, neg.vectors, (pos.block_rows, neg.block_rows), pos.width, cores)
    rows, columns = grid.pos_groups, grid.neg_groups
    width, halves = pos.width, pos.halves

    def dealt(side: TableSide, size: int, groups: int, others: int, cell: str) -> DataFrame:
        held = block_table(side, size).withColumn("own", F.col("first") % groups)
        copies = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        # A number of partitions that is named is not merged by bytes: cells are few bytes but much work.
        return copies.withColumn("cell", F.expr(cell)).repartition(grid.tasks, "cell")

    left = dealt(pos, grid.pos_rows, rows, columns, f"CAST(own AS bigint) * {columns} + other")
    right = dealt(neg, grid.neg_rows, columns, rows, f"CAST(other AS bigint) * {columns} + own")

    def meet(key, p: pa.Table, n: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        p_block, n_block = _block_of(p, width, halves), _block_of(n, width, halves)
        nothing = _nothing(kernel)
        # A group meets all others; its own rows count once.
        counts = (
            kernel.counts(p_block, True) if cell % columns == 0 else nothing,
            kernel.counts(n_block, False) if cell // columns == 0 else nothing,
        )
        sums = kernel.zero() + kernel.sums(p_block, n_block)
        return pa.Table.from_batches([kernel.rows(sums, *counts)])

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(meet, kernel.schema)


def fetch_tally(partials: DataFrame, pos, neg, width: int, nodes: int = 1) -> list:
    """The partial rows on the driver: one row per key and task while those are few,
    else merged to one row per key first."""
    tables = [s for s in (pos, neg) if isinstance(s, TableSide)]
    if len(tables) == 1 and tables[0].tasks * (4 * width + 1) * nodes <= DRIVER_ROWS:
        return partials.collect()
    return merged(partials).collect()


def merged(partials: DataFrame) -> DataFrame:
    """Partial rows summed per key."""
    return partials.groupBy("key").agg(
        F.expr("CAST(sum(r) AS decimal(38,0)) AS r"),
        F.expr("sum(pos) AS pos"),
        F.expr("sum(neg) AS neg"),
    )


def empty_keys(spark: SparkSession, keys: int) -> DataFrame:
    """Zero rows for every key, for keys no pair supports."""
    zero = F.lit(0)
    return spark.range(keys).select(
        F.col("id").cast("int").alias("key"),
        zero.cast("decimal(38,0)").alias("r"),
        zero.cast("bigint").alias("pos"),
        zero.cast("bigint").alias("neg"),
    )
