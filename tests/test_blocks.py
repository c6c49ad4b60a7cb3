import numpy as np
import pytest
from brute import relevance, units
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseforge.functions.masks import Mask
from clauseforge.operators import blocks
from clauseforge.operators.blocks import Block, Rule


def words(rows, value, width):
    out = np.zeros((len(rows), -(-width // 64)), dtype=np.uint64)
    for i, row in enumerate(rows):
        for k, x in enumerate(row):
            if x == value:
                out[i, k // 64] |= np.uint64(1) << np.uint64(k % 64)
    return out.view(np.int64)


def block(rows, width, mult=None, flag=None, halves=False):
    return Block(
        words(rows, 1, width),
        words(rows, 0.5, width) if halves else None,
        np.asarray(mult if mult is not None else [1] * len(rows), dtype=np.int64),
        np.asarray(flag if flag is not None else [True] * len(rows)),
    )


def random_rows(rng, count, width, values=(0, 1)):
    return rng.choice(values, size=(count, width)).tolist()


@pytest.mark.parametrize("width", [1, 5, 64, 70])
def test_relevance_matches_pair_by_pair(width):
    rng = np.random.default_rng(width)
    pos, neg = random_rows(rng, 9, width), random_rows(rng, 7, width)
    got = blocks.relevance_sum(block(pos, width), block(neg, width), Rule(width))
    assert got.tolist() == units(pos, neg)


def test_tiles_do_not_change_the_sum(monkeypatch):
    rng = np.random.default_rng(1)
    pos, neg = random_rows(rng, 40, 12), random_rows(rng, 33, 12)
    whole = blocks.relevance_sum(block(pos, 12), block(neg, 12), Rule(12))
    monkeypatch.setattr(blocks, "TILE", 7)
    assert blocks.relevance_sum(block(pos, 12), block(neg, 12), Rule(12)).tolist() == whole.tolist()


def test_large_multiplicities_are_exact():
    pos, neg = [[1, 0, 1], [0, 0, 1]], [[0, 1, 1], [1, 1, 0]]
    mp, mn = [3, 2**40 + 5], [2**33 + 1, 700]
    got = blocks.relevance_sum(block(pos, 3, mp), block(neg, 3, mn), Rule(3))
    want = [0] * 6
    for p, a in zip(pos, mp):
        for n, b in zip(neg, mn):
            want = [w + a * b * x for w, x in zip(want, units([p], [n]))]
    assert got.tolist() == want
    pairs = blocks.distance_counts(block(pos, 3, mp), block(neg, 3, mn), 3)
    assert sum(pairs) == sum(mp) * sum(mn)


def test_flags_select_pairs_with_a_flagged_row():
    rng = np.random.default_rng(3)
    pos, neg = random_rows(rng, 10, 6), random_rows(rng, 8, 6)
    fp, fn = [i % 3 == 0 for i in range(10)], [i % 4 == 0 for i in range(8)]
    got = blocks.relevance_sum(block(pos, 6, flag=fp), block(neg, 6, flag=fn), Rule(6))
    kept_p = [r for r, f in zip(pos, fp) if not f]
    kept_n = [r for r, f in zip(neg, fn) if not f]
    want = [a - b for a, b in zip(units(pos, neg), units(kept_p, kept_n))]
    assert got.tolist() == want


@pytest.mark.parametrize("halves", ["weighted", "distance"])
def test_uncertain_values_few_rows(halves):
    rng = np.random.default_rng(5)
    pos, neg = random_rows(rng, 4, 6, (0, 0.5, 1)), random_rows(rng, 5, 6, (0, 0.5, 1))
    rule = Rule(6, halves, len(pos) + len(neg))
    got = blocks.relevance_sum(block(pos, 6, halves=True), block(neg, 6, halves=True), rule)
    want = relevance(pos, neg, halves)
    assert [float(g) / 2.0**rule.unit_bits for g in got] == pytest.approx([float(w) for w in want], rel=1e-9)


def test_uncertain_values_many_rows():
    rng = np.random.default_rng(6)
    pos, neg = random_rows(rng, 30, 5, (0, 0.5, 1)), random_rows(rng, 60, 5, (0, 0.5, 1))
    rule = Rule(5, "weighted", 90)
    got = blocks.relevance_sum(block(pos, 5, halves=True), block(neg, 5, halves=True), rule)
    want = relevance(pos, neg)
    assert [float(g) / 2.0**36 for g in got[:10]] == pytest.approx([float(w) for w in want], rel=1e-9)


def test_literal_counts_ignore_uncertain_values():
    rows = block([[1, 0.5], [0, 1]], 2, mult=[3, 4], halves=True)
    assert blocks.literal_counts(rows, 2).tolist() == [3, 4, 4, 0]


@settings(max_examples=50, deadline=None)
@given(st.data())
def test_masks_agree_with_the_definition(data):
    width = data.draw(st.integers(1, 70))
    row = data.draw(st.lists(st.sampled_from([0, 0.5, 1]), min_size=width, max_size=width))
    term = data.draw(st.dictionaries(st.integers(0, width - 1), st.integers(0, 1), max_size=5))
    packed = block([row], width, halves=True)
    mask = Mask.of(term, width)
    assert mask.exact_rows(packed.ones, packed.halves)[0] == all(row[k] == w for k, w in term.items())
    assert mask.allows_rows(packed.ones, packed.halves)[0] == all(row[k] != 1 - w for k, w in term.items())


@pytest.mark.parametrize("tile", [3, 512])
def test_rows_of_many_sizes_and_multiplicities(monkeypatch, tile):
    monkeypatch.setattr(blocks, "TILE", tile)
    rng = np.random.default_rng(tile)
    width = 130
    pos, neg = (
        [(rng.random(width) < rng.random() ** 3).astype(int).tolist() for _ in range(n)] for n in (37, 45)
    )
    neg[3] = pos[5]
    mp, mn = (rng.choice([1, 1, 1, 2, 63, 64, 4097], size=n).tolist() for n in (37, 45))
    left, right = block(pos, width, mp), block(neg, width, mn)
    want, pairs = [0] * (2 * width), [0] * (width + 1)
    for p, a in zip(pos, mp):
        for n, b in zip(neg, mn):
            want = [w + a * b * x for w, x in zip(want, units([p], [n]))]
            pairs[sum(x != y for x, y in zip(p, n))] += a * b
    assert blocks.relevance_sum(left, right, Rule(width)).tolist() == want
    assert blocks.distance_counts(left, right, width).tolist() == pairs


def test_products_take_the_features_in_use(monkeypatch):
    """2,000 features of which a block has a few cost what the few cost."""
    rng = np.random.default_rng(9)
    width, used, rows = 2000, 20, 300
    small = [random_rows(rng, rows, used) for _ in "pn"]
    wide = [[row[:10] + [0] * (width - used) + row[10:] for row in side] for side in small]
    entries = []

    def run(function, sides, *args):
        entries.clear()
        real = blocks.np
        with monkeypatch.context() as patch:
            patch.setattr(blocks, "np", _Counting(real, entries))
            function(*[block(s, len(s[0])) for s in sides], *args)
        return sum(entries)

    for function, narrow_args, wide_args in (
        (blocks.relevance_sum, [Rule(used)], [Rule(width)]), (blocks.distance_counts, [used], [width]),
    ):
        assert run(function, wide, *wide_args) <= run(function, small, *narrow_args) * 2


class _Counting:
    """numpy, noting the sizes of the matrices that products are built from."""

    def __init__(self, real, entries):
        self.real, self.entries = real, entries

    def __getattr__(self, name):
        return getattr(self.real, name)

    def column_stack(self, parts):
        out = self.real.column_stack(parts)
        self.entries.append(out.size)
        return out


def _grouped_sides(rng, width, rows):
    """Rows in four vocabularies: features of nearly all rows, of some, of few, and common to all."""
    sides = []
    for count in rows:
        kind = rng.integers(0, 4, count)
        share = np.full((4, width), 0.01)
        for k in range(4):
            share[k, 10 * k : 10 * k + 5] = [0.98, 1.0, 0.97, 0.5, 0.99]
            share[k, 10 * k + 5 : 10 * k + 10] = 0.02
        share[:, 40:44] = [0.995, 0.5, 0.98, 0.03]
        sides.append((rng.random((count, width)) < share[kind]).astype(int))
    return sides


@pytest.mark.parametrize("tile", [16, 512])
def test_groups_and_listed_pairs_give_the_same_sums(monkeypatch, tile):
    rng = np.random.default_rng(tile)
    width, rows = 70, (90, 110)
    pos, neg = _grouped_sides(rng, width, rows)
    neg[3], pos[4], neg[5] = pos[5], 0, 1
    mp, mn = (rng.choice([1, 1, 1, 63, 64, 2**40 + 5], size=n) for n in rows)
    differ = pos[:, None, :] != neg[None]
    unit = np.array([0] + [round(2**36 / d) for d in range(1, width + 1)], dtype=object)
    weight = unit[differ.sum(axis=2)] * np.outer(mp.astype(object), mn.astype(object))
    want = [int(weight[differ[:, :, k] & (pos[:, None, k] == one)].sum()) for one in (1, 0) for k in range(width)]
    for name, value in (("TILE", tile), ("GROUP_ROWS", 8), ("PIECE", 50), ("RARE", 20)):
        monkeypatch.setattr(blocks, name, value)
    got = blocks.relevance_sum(block(pos.tolist(), width, mp), block(neg.tolist(), width, mn), Rule(width))
    assert got.tolist() == want
    monkeypatch.setattr(blocks, "RARE", 0)
    got = blocks.relevance_sum(block(pos.tolist(), width, mp), block(neg.tolist(), width, mn), Rule(width))
    assert got.tolist() == want


def test_products_leave_out_what_few_pairs_of_a_group_tell(monkeypatch):
    """Matrices of rows in four vocabularies have at most ten of 1,000 features a row and tile."""
    rng = np.random.default_rng(4)
    width = 1000
    pos, neg = (block(side.tolist(), width) for side in _grouped_sides(rng, width, (4096, 4096)))
    entries = []
    monkeypatch.setattr(blocks, "np", _Counting(np, entries))
    blocks.relevance_sum(pos, neg, Rule(width))
    # Two of them are the size and the one that carry both row sums.
    tiles = 4096 / 512
    assert sum(entries) <= 4096 * tiles * 10
