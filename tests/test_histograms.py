"""Pairs by distance among survivors, from stored histograms."""

from collections import Counter

import numpy as np
import pytest
from tables import instances

from clauseforge.functions.masks import Mask
from clauseforge.operators import histograms as hist
from clauseforge.operators.instances import gather_instances
from clauseforge.operators.pairs import ArraySide

WIDTH = 70


def random_sides(p, q, seed, values):
    rng = np.random.default_rng(seed)
    pos = rng.choice(values, size=(p, WIDTH)).tolist()
    neg = rng.choice(values, size=(q, WIDTH)).tolist()
    return pos + pos[:2] * 3, neg + neg[:1] * 4


def by_distance(pos, neg):
    return Counter(sum(a != b for a, b in zip(p, n)) for p in pos for n in neg)


def meets(row, term):
    return all(row[k] == want for k, want in term.items())


def covers(row, term):
    return all(row[k] in (want, 0.5) for k, want in term.items())


def found(df):
    return {r["d"]: int(r["pairs"]) for r in df.collect()}


@pytest.mark.parametrize("values", [[0, 1], [0, 0.5, 1]])
@pytest.mark.parametrize("limit", [1 << 26, 17 * 20])
def test_survivors_equal_a_recount(spark, values, limit):
    pos, neg = random_sides(70, 50, 3, values)
    gathered = gather_instances(instances(spark, pos, neg, 3))
    stored = hist.distance_histograms(gathered, limit)
    assert found(stored.pairs()) == by_distance(pos, neg)
    few = {0: 1, 1: 0, 65: 1}  # few rows meet it, most miss it
    for term in ({}, {3: 1}, {66: 0}, few):
        for strategy in ("broadcast_positive", "broadcast_negative", "cross"):
            kept = found(hist.distances_meeting(stored, term, strategy, limit))
            assert kept == by_distance(
                [r for r in pos if meets(r, term)], [r for r in neg if meets(r, term)]
            )
            left = found(hist.distances_uncovered(stored, term, strategy, limit))
            assert left == by_distance([r for r in pos if not covers(r, term)], neg)
    stored.release()
    gathered.release()


def test_fewer_pairs_are_looked_at(spark, monkeypatch):
    """A literal that most positives meet: only those that are gone meet the negatives again."""
    rng = np.random.default_rng(5)
    pos, neg = rng.choice([0, 1], size=(200, WIDTH)), rng.choice([0, 1], size=(60, WIDTH))
    pos[:, 4] = [0] * 20 + [1] * 180
    neg[:, 4] = [0] * 10 + [1] * 50
    gathered = gather_instances(instances(spark, pos.tolist(), neg.tolist()))
    stored = hist.distance_histograms(gathered)
    sizes = lambda s: len(s.block) if isinstance(s, ArraySide) else s.df.count()
    read = []
    tally = hist.distance_tally

    def counted(p, n, width):
        read.append(sizes(p) * sizes(n))
        return tally(p, n, width)

    monkeypatch.setattr(hist, "distance_tally", counted)
    kept = found(hist.distances_meeting(stored, {4: 1}))
    assert kept == by_distance(pos[20:].tolist(), neg[10:].tolist())
    assert read == [20 * 50]
    assert hist.vectors_by(gathered, Mask.of({4: 1}, WIDTH).exact(False)) == (180, 20)
    left = found(hist.distances_uncovered(stored, {4: 0}))
    assert left == by_distance(pos[20:].tolist(), neg.tolist())
    assert read[1:] == [20 * 60]


def test_a_side_may_be_far_larger(spark):
    pos, neg = random_sides(3, 400, 9, [0, 1])
    stored = hist.distance_histograms(gather_instances(instances(spark, pos, neg, 4)), 17 * 16)
    assert found(hist.distances_uncovered(stored, {0: 1})) == by_distance(
        [r for r in pos if r[0] != 1], neg
    )
    assert stored.df.selectExpr("max(d)").head()[0] <= WIDTH
