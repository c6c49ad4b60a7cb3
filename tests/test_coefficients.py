"""Relevance as coefficients of the weight of an uncertain value."""

from fractions import Fraction

import numpy as np
import pytest
from brute import relevance as brute_relevance
from tables import instances

from clauseforge.operators.instances import gather_instances
from clauseforge.operators.relevance import (
    coefficients_after,
    relevance,
    relevance_after,
    relevance_coefficients,
    relevance_of,
)

STRATEGIES = ["broadcast_positive", "broadcast_negative", "cross"]
WIDTH = 5


def random_sides(p, q, seed):
    rng = np.random.default_rng(seed)
    pos = rng.choice([0, 0.5, 1], size=(p, WIDTH)).tolist()
    neg = rng.choice([0, 0.5, 1], size=(q, WIDTH)).tolist()
    return pos + pos[:2] * 3, neg + neg[:1] * 4


def exact(rows, u):
    """Relevance by literal as fractions."""
    total = [Fraction(0)] * (2 * WIDTH)
    for r in rows:
        total[r["lit"]] += (int(r["full"]) + u * int(r["part"]) / 2) / (r["certain"] + u * r["unsure"])
    return total


def meeting(rows, term):
    return [r for r in rows if all(r[k] == want for k, want in term.items())]


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("sizes", [(4, 6), (30, 50)])
def test_coefficients_hold_the_exact_relevance(spark, strategy, sizes):
    pos, neg = random_sides(*sizes, seed=sum(sizes))
    gathered = gather_instances(instances(spark, pos, neg, 3))
    u = Fraction(1, 2 ** (len(pos) + len(neg)))
    whole = relevance_coefficients(gathered, strategy, limit=33 * 8)
    assert exact(whole.collect(), u) == brute_relevance(pos, neg)
    assert whole.select("lit", "certain", "unsure").distinct().count() == whole.count()
    # One literal more, then another: u is another each time, the sums are subtracted.
    left, term = whole, {}
    for literal in (0, WIDTH + 2):
        left = coefficients_after(gathered, left, literal, term, strategy, limit=33 * 8)
        term[literal % WIDTH] = int(literal < WIDTH)
        p, n = meeting(pos, term), meeting(neg, term)
        u = Fraction(1, 2 ** (len(p) + len(n)))
        wanted = brute_relevance(p, n) if p and n else [0] * (2 * WIDTH)
        assert exact(left.collect(), u) == wanted
        again = relevance_coefficients(gathered, term=term)
        assert sorted(map(tuple, left.collect())) == sorted(map(tuple, again.collect()))


@pytest.mark.parametrize("sizes", [(4, 6), (30, 50), (60, 90)])
def test_relevance_after_equals_recomputation(spark, sizes):
    pos, neg = random_sides(*sizes, seed=7)
    gathered = gather_instances(instances(spark, pos, neg, 2))
    again = {r["lit"]: int(r["r"]) for r in relevance(gathered, term={1: 1}).collect()}
    rows = len(meeting(pos, {1: 1})) + len(meeting(neg, {1: 1}))
    for before in (relevance_coefficients(gathered), relevance(gathered)):
        got = {r["lit"]: int(r["r"]) for r in relevance_after(gathered, before, 1).collect()}
        assert got.keys() == again.keys()
        # Few rows are rounded to units of 2**-90 per pair or per kind of pair.
        slack = 2 * len(pos) * len(neg) if rows <= 64 else 0
        assert all(abs(got[k] - again[k]) <= slack for k in again)


def test_no_pairs(spark):
    gathered = gather_instances(instances(spark, [(1, 0.5)], [(0, 0)]))
    none = relevance_coefficients(gathered, term={0: 0})
    assert none.count() == 0
    assert {int(r["r"]) for r in relevance_of(none, 2, 1).collect()} == {0}
