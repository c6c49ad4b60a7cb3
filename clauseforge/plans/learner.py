"""The greedy learner: at most one Spark job per literal.

The driver keeps the terms found so far and 2n numbers; rows stay in Spark. Each
step is a query over the same distinct-vector table, filtered by the partial
term, so plans do not grow with the number of steps and a lost executor costs
only its own tasks.

Because relevance is summed in whole units, it can also be carried forward: the
relevance of what is left is the relevance of what was, minus the pairs with an
erased row. Each step runs whichever of the two covers fewer pairs. For the first
literal of a new term this replaces (positives left) x (all negatives) by
(positives just covered) x (all negatives), so those steps cost about one full
product over the whole training instead of one per term.

A job also looks ahead: while the pairs of a step are few, it sums them for the
literals too that are likely to be chosen next, by the order they had one step or
one term earlier. Where one of them is chosen, its step needs no job. What is
chosen does not depend on it.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.errors import InconsistentDataError, NoProgressError
from clauseforge.functions.masks import Mask
from clauseforge.functions.predicates import split_literal
from clauseforge.operators.blocks import Rule
from clauseforge.operators.instances import Instances, gather_instances, union_sides
from clauseforge.operators.pairs import (
    BROADCAST_LIMIT,
    TOTALS,
    ArraySide,
    Node,
    TableSide,
    array_side,
    choose_strategy,
    fetch_tally,
    node_tally,
    pair_tally,
)
from clauseforge.operators.relevance import sides
from clauseforge.plans.model import RuleModel
from clauseforge.storage import discard, keep_table

log = logging.getLogger(__name__)

VERSION = "clauseforge 1.0"
# Positives left are re-materialised after this many terms, which bounds the
# filter a step evaluates.
TERMS_PER_CUT = 16
# Literals a job looks ahead for after a literal and after a term, and for each of the
# first of the latter how many second ones.
NEXT_LITERALS, FIRST_LITERALS, SECOND_LITERALS, WITH_SECOND = 12, 10, 6, 6
# Pair-literal products that cost less than another job would.
FREE_WORK = 1 << 30
# States of earlier nodes that are kept to order the literals below them.
STATES_KEPT = 512

TRACE_SCHEMA = (
    "term_no int, step int, lit int, r decimal(38,0), unit_bits int, p bigint, q bigint, carried boolean"
)


@dataclass(frozen=True)
class Step:
    """One chosen literal: its relevance units and what is left after it."""

    term_no: int
    step: int
    lit: int
    r: int
    unit_bits: int
    p: int
    q: int
    carried: bool


@dataclass
class _State:
    """Per-literal sums over the current positives and negatives."""

    r: np.ndarray
    second: np.ndarray
    pos: np.ndarray
    neg: np.ndarray
    p: int
    q: int
    rule: Rule
    carried: bool = False

    def minus(self, lost: _State, p: int, q: int, rule: Rule) -> _State:
        return _State(
            self.r - lost.r, self.second - lost.second, self.pos - lost.pos, self.neg - lost.neg,
            p, q, rule, carried=True,
        )

    def best(self) -> int:
        """Index of the largest relevance; second sums, then the lowest index, decide a tie."""
        return max(range(len(self.r)), key=lambda k: (self.r[k], self.second[k], -k))


class _Training:
    def __init__(
        self,
        instances: Instances,
        strategy: str,
        limit: int,
        halves: str,
        carry: bool,
        partitions: tuple[int | None, int | None],
    ):
        self.width = instances.width
        self.has_halves = instances.halves
        self.halves = halves if instances.halves else None
        self.carry = carry
        self.pos, self.neg = self._originals = sides(instances, strategy, limit, *partitions)
        # With both sides too large to broadcast, later steps may still have few rows left.
        self.broadcast_rows = 0 if strategy == "cross" else limit // instances.row_bytes
        self.p, self.q = instances.positives, instances.negatives
        self.trace: list[Step] = []
        # States by conjunction: those of the present root, and the latest of any root.
        self.known: dict[frozenset, _State] = {}
        self.seen: dict[frozenset, _State] = {}
        self._owned: DataFrame | None = None
        self._owned_path: str | None = None

    def rule(self, p: int, q: int) -> Rule:
        return Rule(self.width, self.halves, p + q)

    def tally(self, pos, neg, p: int, q: int, rule: Rule | None = None) -> _State:
        """Sum up the pairs that have a flagged row, among at most p and q rows, in one job.

        If neither side is an array, the smaller one is fetched first once its
        bound is below the broadcast limit.
        """
        rule = rule or self.rule(p, q)
        pos, neg = self._formed(_bounded(pos, p), _bounded(neg, q))
        rows = self._fetched(pair_tally(pos, neg, rule), pos, neg)
        size = 2 * self.width
        state = _State(
            *[np.zeros(size, dtype=object) for _ in range(4)],
            p,
            q,
            rule,
        )
        for row in rows:
            if row["key"] >= size:
                state.second[row["key"] - size] += int(row["r"])
            elif row["key"] != TOTALS:
                state.r[row["key"]] += int(row["r"])
                state.pos[row["key"]] += row["pos"]
                state.neg[row["key"]] += row["neg"]
        for side, counts in ((pos, state.pos), (neg, state.neg)):
            if isinstance(side, ArraySide):
                counts += side.flagged_counts()[0].astype(object)
        return state

    def _fetched(self, tallied, pos, neg, nodes: int = 1) -> list:
        partials, sent = tallied
        try:
            return fetch_tally(partials, pos, neg, self.width, nodes)
        finally:
            if sent is not None:
                sent.destroy()

    def tally_nodes(self, pos, neg, p: int, q: int, nodes: list[Node]) -> list[_State]:
        """The sums of several nodes over at most p and q rows of 0/1 data, in one job."""
        rule = self.rule(p, q)
        pos, neg = self._formed(_bounded(pos, p), _bounded(neg, q))
        size = 2 * self.width
        states = [_State(*[np.zeros(size, dtype=object) for _ in range(4)], p, q, rule) for _ in nodes]
        for row in self._fetched(node_tally(pos, neg, rule, nodes), pos, neg, len(nodes)):
            if row["key"] != TOTALS:
                state, key = states[row["key"] // size], row["key"] % size
                state.r[key] += int(row["r"])
                state.pos[key] += row["pos"]
                state.neg[key] += row["neg"]
        for side, name in ((pos, "pos"), (neg, "neg")):
            if isinstance(side, ArraySide):
                for node, state in zip(nodes, states):
                    rows = ArraySide(node.of(side.block, name == "pos"), self.width)
                    getattr(state, name)[:] += rows.flagged_counts()[0].astype(object)
        return states

    def _likely(self, state: _State, term: dict[int, int], count: int) -> list[tuple[dict[int, int], int, int]]:
        """Longer terms by the relevance their last literal has in ``state``, with bounds of their rows.

        Literals that leave no row on one side end a term and need no sums.
        """
        order = sorted(range(2 * self.width), key=lambda k: (-state.r[k], k))
        found = []
        for literal in order:
            feature, want = split_literal(literal, self.width)
            if feature not in term and state.r[literal] and state.pos[literal] and state.neg[literal]:
                found.append(({**term, feature: want}, int(state.pos[literal]), int(state.neg[literal])))
                if len(found) == count:
                    break
        return found

    def _affordable(self, likely: list[tuple[dict[int, int], int, int]], own: int) -> list[dict[int, int]]:
        """Those whose pairs together are no more than the job's own, or so few that a job costs more."""
        left = max(own, FREE_WORK // (2 * self.width))
        out = []
        for term, p, q in likely:
            if p * q <= left:
                left -= p * q
                out.append(term)
        return out

    def _remember(self, terms: list[dict[int, int]], states: list[_State]) -> None:
        if self.looks_ahead:
            self.known.update((frozenset(t.items()), s) for t, s in zip(terms, states))

    @property
    def looks_ahead(self) -> bool:
        # The weight of an uncertain value hangs on the rows left, which are not known ahead.
        return self.carry and not self.has_halves

    def _formed(self, pos, neg):
        if isinstance(pos, TableSide) and isinstance(neg, TableSide):
            small = min(pos.vectors, neg.vectors)
            if small <= self.broadcast_rows:
                if pos.vectors == small:
                    pos = array_side(pos.df, self.width, self.has_halves)
                else:
                    neg = array_side(neg.df, self.width, self.has_halves)
        return pos, neg

    def root(self) -> _State:
        """All positives left against all negatives."""
        everything = Mask.empty(self.width)
        return self.tally(self.pos.pick(everything), self.neg.pick(everything), self.p, self.q)

    def _can_carry(self, before: _State, p: int, q: int, lost: int, kept: int) -> bool:
        fine = before.rule.fine or self.rule(p, q).fine
        return self.carry and not fine and lost < kept

    def advance(self, state: _State, term: dict[int, int], literal: int, p: int, q: int) -> _State:
        """Sums after ``literal`` joins ``term``, when p and q rows are left."""
        feature, want = split_literal(literal, self.width)
        found = self.known.get(frozenset({**term, feature: want}.items()))
        if found is not None:
            return replace(found, p=p, q=q)
        kept = p * q
        if self._can_carry(state, p, q, state.p * state.q - kept, kept):
            keep, chosen = Mask.of(term, self.width), Mask.of({feature: want}, self.width)
            lost = self.tally(
                self.pos.pick(keep, chosen), self.neg.pick(keep, chosen), state.p, state.q
            )
            return state.minus(lost, p, q, self.rule(p, q))
        longer = {**term, feature: want}
        keep = Mask.of(longer, self.width)
        ahead = []
        if self.looks_ahead:
            likely = [
                (t, min(p, p_c), min(q, q_c))
                for t, p_c, q_c in self._likely(state, longer, NEXT_LITERALS)
            ]
            ahead = self._affordable(likely, kept)
        if not ahead:
            return self.tally(self.pos.pick(keep), self.neg.pick(keep), p, q)
        nodes = [Node(Mask.of(t, self.width), True) for t in (longer, *ahead)]
        own, *more = self.tally_nodes(self.pos.pick(keep), self.neg.pick(keep), p, q, nodes)
        self._remember(ahead, more)
        return own

    def learn_term(self, term_no: int, state: _State) -> dict[int, int]:
        term: dict[int, int] = {}
        while True:
            literal = state.best()
            feature, want = split_literal(literal, self.width)
            p, q = int(state.pos[literal]), int(state.neg[literal])
            step = Step(
                term_no, len(self.trace) + 1, literal, int(state.r[literal]),
                state.rule.unit_bits, p, q, state.carried,
            )
            self.trace.append(step)
            log.info("term %d: literal %d, p=%d, q=%d", term_no, literal, p, q)
            if q == state.q:
                raise InconsistentDataError(
                    f"literal {literal} of term {term_no} removes no negative; "
                    "some vector carries both labels"
                )
            if p == 0 or q == 0:
                return {**term, feature: want}
            state = self.advance(state, term, literal, p, q)
            term[feature] = want
            self._remember([term], [state])

    def cover(self, state: _State, term: dict[int, int], term_no: int) -> _State | None:
        """Drop the positives ``term`` covers; the next root state, or None when none is left."""
        mask = Mask.of(term, self.width)
        covered_side = self.pos.covered(mask)
        covered = self._covered_rows(covered_side)
        if covered == 0:
            raise NoProgressError(
                f"term {term_no} covers none of the {self.p} positives left; "
                "some vector carries both labels"
            )
        left = self.p - covered
        if left == 0:
            self.p = 0
            return None
        ahead = self._after_term(state, covered) if self.looks_ahead else []
        carried = self._can_carry(state, left, self.q, covered, left)
        if ahead:
            nodes = [Node(Mask.empty(self.width), carried)]
            nodes += [Node(Mask.of(t, self.width), False) for t in ahead]
            everything = Mask.empty(self.width)
            own, *more = self.tally_nodes(
                self.pos.marked(mask), self.neg.pick(everything), self.p, self.q, nodes
            )
            self._remember(ahead, more)
            self.pos = self.pos.uncovered(mask)
            self.p = left
            self._cut_if_due(term_no)
            if not carried:
                return replace(own, p=left, q=self.q, rule=self.rule(left, self.q))
            own.neg = np.zeros_like(own.neg)
            return state.minus(own, left, self.q, self.rule(left, self.q))
        if carried:
            everything = Mask.empty(self.width)
            lost = self.tally(covered_side, self.neg.pick(everything), covered, self.q, state.rule)
            # The negatives are all still there.
            lost.neg = np.zeros_like(lost.neg)
        self.pos = self.pos.uncovered(mask)
        self.p = left
        self._cut_if_due(term_no)
        return state.minus(lost, left, self.q, self.rule(left, self.q)) if carried else self.root()

    def _after_term(self, root: _State, covered: int) -> list[dict[int, int]]:
        """Terms of one and two literals that the next term may begin with.

        The root and the nodes below it lose the covered positives only, so their
        literals keep about the order they have now.
        """
        self.seen = {**self.seen, **self.known}
        for key in list(self.seen)[: max(0, len(self.seen) - STATES_KEPT)]:
            del self.seen[key]
        self.known = {}
        first = self._likely(root, {}, FIRST_LITERALS)
        likely = list(first)
        for term, _, _ in first[:WITH_SECOND]:
            below = self.seen.get(frozenset(term.items()))
            if below is not None:
                likely += self._likely(below, term, SECOND_LITERALS)
        return self._affordable(likely, covered * self.q)

    def _covered_rows(self, covered_side) -> int:
        if isinstance(covered_side, ArraySide):
            return int(covered_side.block.mult.sum())
        if not self.has_halves:
            # Without uncertain values the covered rows are the last survivors.
            return self.trace[-1].p
        return covered_side.df.agg(F.coalesce(F.sum("mult"), F.lit(0)).alias("rows")).head()["rows"]

    def _cut_if_due(self, term_no: int) -> None:
        if isinstance(self.pos, TableSide) and term_no % TERMS_PER_CUT == 0:
            earlier, earlier_path = self._owned, self._owned_path
            kept, self._owned_path = keep_table(self.pos.df, "left")
            self._owned = kept.repartition(self.pos.tasks).persist(StorageLevel.MEMORY_AND_DISK)
            self.pos = replace(self.pos, df=self._owned)
            if earlier is not None:
                earlier.unpersist()
                discard(kept.sparkSession, earlier_path)

    def release(self) -> None:
        held = [side.df for side in self._originals if isinstance(side, TableSide)]
        for df in (self._owned, *held):
            if df is not None and df.is_cached:
                df.unpersist()
        if self._owned_path:
            discard(self._owned.sparkSession, self._owned_path)


def _bounded(side, rows: int):
    """A distributed side cannot have more vectors than rows."""
    if isinstance(side, TableSide):
        return replace(side, vectors=min(side.vectors, rows))
    return side


def _default_halves(strategy: str) -> str:
    """Uncertain values add relevance only when positives are broadcast (or on auto)."""
    return "weighted" if strategy in ("auto", "broadcast_positive") else "distance"


def train(
    instances: Instances,
    strategy: str = "auto",
    limit: int = BROADCAST_LIMIT,
    halves: str | None = None,
    carry: bool = True,
    partitions: tuple[int | None, int | None] = (None, None),
    max_terms: int | None = None,
) -> tuple[list[dict[int, int]], list[Step]]:
    """Terms and trace from gathered instances. ``max_terms`` stops a trial run early."""
    training = _Training(
        instances, strategy, limit, halves or _default_halves(strategy), carry, partitions
    )
    terms: list[dict[int, int]] = []
    try:
        state = training.root()
        while state is not None and (max_terms is None or len(terms) < max_terms):
            term_no = len(terms) + 1
            terms.append(training.learn_term(term_no, state))
            if max_terms is not None and term_no == max_terms:
                break
            state = training.cover(state, terms[-1], term_no)
    finally:
        training.release()
    return terms, training.trace


def fit_labelled(
    df: DataFrame,
    label: str = "label",
    features: str = "features",
    *,
    strategy: str = "auto",
    on_conflict: str = "error",
    use_cache: bool = True,
    verbose: bool = False,
    halves: str | None = None,
    carry: bool = True,
    limit: int = BROADCAST_LIMIT,
    partitions: tuple[int | None, int | None] = (None, None),
    max_terms: int | None = None,
    width: int | None = None,
) -> RuleModel:
    """Learn a formula that tells ``label = 1`` from ``label = 0``."""
    if verbose:
        logging.basicConfig(level=logging.INFO)
        log.setLevel(logging.INFO)
    started = time.perf_counter()
    instances = gather_instances(
        df, label, features, on_conflict, _widest(partitions), cache=use_cache, width=width
    )
    chosen = choose_strategy(
        strategy,
        instances.positive_vectors,
        instances.negative_vectors,
        instances.row_bytes,
        limit,
    )
    try:
        terms, trace = train(
            instances, strategy, limit, halves, carry, partitions, max_terms
        )
    finally:
        instances.release()
    return RuleModel(
        terms=terms,
        width=instances.width,
        version=f"{VERSION} - {chosen}",
        training_time=time.perf_counter() - started,
        training_pos=instances.positives,
        training_neg=instances.negatives,
        trace=trace,
    )


def _widest(partitions: tuple[int | None, int | None]) -> int | None:
    wanted = [n for n in partitions if n and n > 0]
    return max(wanted) if wanted else None


def fit(
    positive: DataFrame,
    negative: DataFrame,
    verbose: bool = False,
    use_cache: bool = True,
    **options,
) -> RuleModel:
    """Learn from a positive and a negative set, each with a ``features`` column."""
    return fit_labelled(
        union_sides(positive, negative), verbose=verbose, use_cache=use_cache, **options
    )


def trace_table(spark: SparkSession, trace: list[Step]) -> DataFrame:
    """The steps of a training run as rows."""
    rows = [
        (s.term_no, s.step, s.lit, Decimal(s.r), s.unit_bits, s.p, s.q, s.carried) for s in trace
    ]
    return spark.createDataFrame(rows, TRACE_SCHEMA)


def learn_term(df: DataFrame, label: str = "label", features: str = "features", **options) -> DataFrame:
    """The steps that build the first term, one row per chosen literal."""
    model = fit_labelled(df, label, features, max_terms=1, **options)
    return trace_table(df.sparkSession, model.trace)
