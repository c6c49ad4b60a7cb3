import math
from fractions import Fraction

import numpy as np
import pytest

from clauseforge.llm import whitening


def brute(rows, count=4):
    """Per row the exact x and deviation, then V by centred products in whole numbers."""
    kept = [
        (i, [math.floor(256 * c) for c in v])
        for i, v in rows
        if v and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = [list(x) for x in {tuple(x) for _, x in kept}]
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    v = np.empty((d, d))
    for a in range(d):
        for b in range(d):
            product = sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit)
            v[a, b] = float(Fraction(product, n**3))
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:count]
    out = []
    for i, x in kept:
        deviation = sum((n * x[k] - sums[k]) ** 2 for k in range(d))
        centred = np.array([float(Fraction(n * x[k] - sums[k], n)) for k in range(d)])
        for place, k in enumerate(order):
            out.append((
                i, place + 1, n, deviation, abs(float(centred @ vectors[:, k])) / math.sqrt(values[k]),
                values[k] / np.trace(v),
            ))
    return out


def check(got, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[4])
    mine = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=key)
    wanted = sorted(wanted, key=key)
    assert [m[:4] for m in mine] == [w[:4] for w in wanted]
    for m, w in zip(mine, wanted):
        assert m[4] == pytest.approx(w[4], rel=1e-6, abs=1e-8) and m[5] == pytest.approx(w[5], rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]
    got = whitening.whiten(docs).collect()
    check(got, brute(rows))
    # One sign for all rows, and uncorrelated unit variances over the fit list.
    parts = {k: [r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == k] for k in (1, 2, 3, 4)}
    assert len({len(p) for p in parts.values()}) == 1


def test_repeats_nulls_and_bad_entries(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(3, 1 + i % 3, 6)]) for i in range(40)]
    odd = [
        (100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6),
        (104, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (105, [0.0, -0.0, 0.0, -0.001, 0.0, 0.0]),
        (None, [1.0] * 6), (None, [1.0] * 6), good[0], good[0], (5, good[1][1]),
    ]
    rows = good + odd + [(200 + i, [0.5] * 6) for i in range(50)]
    df = table(spark, [(*r, 0) for r in rows]).repartition(5)
    clashing = df.selectExpr("vec_id", "embedding", "label AS VEC_ID", "label AS Embedding")
    got = whitening.whiten(clashing).collect()
    check(got, brute(rows))
    again = whitening.whiten(df.repartition(2)).collect()
    # Another partitioning gives the same numbers to the last bit, bar the measured error.
    same = lambda rows: sorted(map(repr, (r[:6] for r in rows)))
    assert same(got) == same(again)


def test_other_lengths_large_entries_and_no_variance(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [3.0, 2.5], 0), (3, [1.0], 0), (4, [-7.0, 1.0], 0)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r.vec_id for r in got} == {1, 2, 4} and {r.component for r in got} == {1, 2}
    check(got, brute([(i, v) for i, v, _ in rows if len(v) == 2]))
    huge = [(i, [float(10 ** (4 * i)), float(i * i)]) for i in range(5)] + [(9, [1e300, 0.0])]
    got = whitening.whiten(table(spark, [(*r, 0) for r in huge[:4]])).collect()
    fits = lambda deviation: deviation if deviation < 2**63 else None
    wanted = [(*b[:3], fits(b[3])) for b in sorted(brute(huge[:4]))]
    assert [tuple(r[:4]) for r in sorted(got, key=lambda r: r[:2])] == wanted
    beyond = whitening.whiten(table(spark, [(*r, 0) for r in huge])).collect()
    assert len(beyond) == 12 and all(r.deviation is None for r in beyond)
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, 0.0, 0.0, 0.0)] * 4
    flat = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1, 2, 3} and all(r.whitened == 0 for r in flat if r.component > 1)
    assert flat[0].identity_error < 1e-9


def test_empty_table(spark):
    none = whitening.whiten(table(spark, []))
    assert none.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]
    assert none.count() == 0 and whitening.whiten(table(spark, [(1, None, 0)])).count() == 0


def test_polarisation_equals_products():
    rng = np.random.default_rng(1)
    x = rng.integers(-90, 90, (300, 7))
    sums = x.sum(axis=0).tolist()
    n = len(x)
    squares = []
    for i, j in whitening.pair_places(7):
        y = x[:, i] + x[:, j] if i != j else x[:, i]
        squares.append(sum((n * int(a) - int(y.sum())) ** 2 for a in y))
    v = whitening.polarised_covariance(squares, n, 7)
    centred = x - np.array(sums) / n
    assert np.allclose(v, centred.T @ centred / n, rtol=1e-12)
