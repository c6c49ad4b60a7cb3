"""Pair arithmetic over two small blocks of packed rows.

Spark decides which blocks meet (see ``pairs.py``); this file only turns one
pair of blocks into sums. Every weight is a whole number of 2**-36 units, so the
sums are exact and do not depend on how rows were partitioned or ordered.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

UNIT_BITS = 36
# Tiles of at most 512 rows with multiplicity digits below 256 keep each
# weighted row sum under 512 * 2**8 * 2**36 = 2**53, exact in a double.
TILE = 512
DIGIT_BITS = 8
# Rows without uncertain values meet in tiles that are up to four times as wide, and
# half as high or, for relevance, of as many pairs. Digits are shorter by as much.
FLAT_WIDE, FLAT_HIGH = 4, 2
FLAT_DIGIT_BITS = 6
# Relevance is added up a piece of rows of either side at a time, with 2**15 rows at
# most: sums over all pairs of a piece in two parts stay exact in doubles.
PIECE, PIECE_BITS = 1 << 15, 1 << 26
# A feature is listed by pair where fewer than one in so many pairs of a tile are listed.
RARE = 160
# Groups of rows alike: how many and of how many rows, the features and the rows
# per group that are looked at to find them, and how often centres move.
GROUPS, GROUP_ROWS, GROUP_FEATURES, GROUP_PROBES, GROUP_MOVES = 16, 1 << 10, 256, 128, 6
# Bins for which the distances of two rows are counted as one number.
PAIRED_BINS = 1 << 17
# Up to this many rows on both sides together, an uncertain value weighs
# u = 0.5**(p+q) on the scale below. Beyond, u is smaller than any difference
# of whole units, and a second sum per literal orders what the first leaves
# equal: the factor of u in the relevance, in units of 2**-24.
FINE_ROWS = 64
FINE_BITS = 90
SECOND_BITS = 24


@dataclass(frozen=True)
class Rule:
    """How a pair is weighed.

    ``halves``: None for pure 0/1 data, ``"weighted"`` to let uncertain values
    add relevance, ``"distance"`` to let them add distance only. ``rows`` is p+q
    of the step; it matters to ``"weighted"`` alone.
    """

    width: int
    halves: str | None = None
    rows: int = 0

    @property
    def fine(self) -> bool:
        return self.halves == "weighted" and self.rows <= FINE_ROWS

    @property
    def seconds(self) -> bool:
        """Whether every literal has a second sum."""
        return self.halves == "weighted" and not self.fine

    @property
    def sums(self) -> int:
        """Numbers per pair of blocks: 2n, and 2n more with second sums."""
        return (4 if self.seconds else 2) * self.width

    @property
    def unit_bits(self) -> int:
        return FINE_BITS if self.fine else UNIT_BITS


@dataclass(frozen=True)
class Block:
    """Packed rows: word arrays, row multiplicities, and the flag of each row."""

    ones: np.ndarray
    halves: np.ndarray | None
    mult: np.ndarray
    flag: np.ndarray

    def __len__(self) -> int:
        return len(self.mult)

    def take(self, rows) -> Block:
        return Block(
            self.ones[rows],
            None if self.halves is None else self.halves[rows],
            self.mult[rows],
            self.flag[rows],
        )

    def flagged(self, flag: np.ndarray) -> Block:
        return replace(self, flag=flag)

    def joined(self, other: Block) -> Block:
        halves = None if self.halves is None else np.concatenate([self.halves, other.halves])
        return Block(
            np.concatenate([self.ones, other.ones]), halves,
            np.concatenate([self.mult, other.mult]), np.concatenate([self.flag, other.flag]),
        )


def block_from_arrow(batch, width: int, halves: bool) -> Block:
    """A block from Arrow columns ``w*``, ``h*``, ``mult`` and, if present, ``flag``."""
    words = -(-width // 64)
    if batch.num_rows == 0:  # one side of a cell may be missing, columns and all
        none = np.zeros((0, words), dtype=np.int64)
        return Block(none, none if halves else None, np.zeros(0, np.int64), np.zeros(0, bool))

    def values(name: str, dtype) -> np.ndarray:
        return np.asarray(batch.column(name).to_numpy(zero_copy_only=False), dtype=dtype)

    def stack(prefix: str) -> np.ndarray:
        return np.column_stack([values(f"{prefix}{i}", np.int64) for i in range(words)])

    has_flag = "flag" in batch.schema.names
    return Block(
        stack("w"),
        stack("h") if halves else None,
        values("mult", np.int64),
        values("flag", bool) if has_flag else np.ones(batch.num_rows, dtype=bool),
    )


def packed_batch(batch: pa.RecordBatch, width: int, kept: int) -> pa.RecordBatch:
    """The first ``kept`` columns as they are, then the features of the next as words.

    Features are lists of values, vectors in Spark's sparse or dense form, or sets
    of active features; the last two become words from their indices, without a
    value per feature.
    """
    features = batch.column(kept)
    if features.null_count:
        raise _unsound(width)
    found = (_struct_words if pa.types.is_struct(features.type) else _list_words)(features, width)
    columns = list(batch.columns[:kept])
    for words in found:
        columns += [pa.array(words[:, i]) for i in range(words.shape[1])]
    names = batch.schema.names[:kept]
    names += [f"{plane}{i}" for plane in "wh" for i in range(-(-width // 64))]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _unsound(width: int) -> ValueError:
    return ValueError(f"a feature vector is not {width} values of 0, 0.5 or 1")


def _list_words(lists, width: int) -> list[np.ndarray]:
    """Words of the ones and of the halves of lists of ``width`` values."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sound = not lists.null_count and bool((lists.value_lengths().to_numpy() == width).all())
    one, half = values == 1.0, values == 0.5
    if not sound or not (one | half | (values == 0.0)).all():
        raise _unsound(width)
    out = []
    for bits in (one, half):
        padded = np.zeros((len(lists), -(-width // 64) * 64), dtype=bool)
        padded[:, :width] = bits.reshape(-1, width)
        out.append(np.packbits(padded, axis=1, bitorder="little").view(np.int64))
    return out


def _struct_words(vectors, width: int) -> list[np.ndarray]:
    """The same for structs of ``size`` and ``indices``, which may also have ``values`` and a ``type``."""
    names = [field.name for field in vectors.type]
    out = [np.zeros((len(vectors), -(-width // 64)), dtype=np.int64) for _ in "wh"]
    dense = np.zeros(len(vectors), dtype=bool)
    if "type" in names:
        dense = vectors.field("type").to_numpy(zero_copy_only=False) == 1
    if dense.any():
        rows = np.flatnonzero(dense)
        for words, found in zip(out, _list_words(vectors.field("values").take(pa.array(rows)), width)):
            words[rows] = found
    rows = np.flatnonzero(~dense)
    sparse = vectors if len(rows) == len(vectors) else vectors.take(pa.array(rows))
    sizes, lists = sparse.field("size"), sparse.field("indices")
    if sizes.null_count or lists.null_count or (sizes.to_numpy(zero_copy_only=False) != width).any():
        raise _unsound(width)
    flat = lists.flatten()
    at = flat.to_numpy(zero_copy_only=False)
    values = np.ones(len(at))
    if "values" in names:
        values = sparse.field("values").flatten().to_numpy(zero_copy_only=False)
    within = not flat.null_count and len(values) == len(at) and (not len(at) or 0 <= at.min() and at.max() < width)
    if not within or not np.isin(values, (0.0, 0.5, 1.0)).all():
        raise _unsound(width)
    owner = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy(zero_copy_only=False))
    for words, value in zip(out, (1.0, 0.5)):
        hit = values == value
        words[rows] = _set_bits(owner[hit], at[hit], len(rows), words.shape[1])
    return out


def _set_bits(owner: np.ndarray, feature: np.ndarray, rows: int, words: int) -> np.ndarray:
    """Word arrays of ``rows`` rows in which the given features of the given rows are set."""
    flat = np.zeros(rows * words, dtype=np.uint64)
    if len(feature):
        place = owner * words + feature // 64
        bit = np.left_shift(np.uint64(1), (feature % 64).astype(np.uint64))
        if (place[1:] < place[:-1]).any():
            order = np.argsort(place, kind="stable")
            place, bit = place[order], bit[order]
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        flat[place[starts]] = np.bitwise_or.reduceat(bit, starts)
    return flat.view(np.int64).reshape(rows, words)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """Word arrays to a 0/1 matrix, one column per feature."""
    raw = np.ascontiguousarray(words).view(np.uint8)
    return np.unpackbits(raw, axis=1, count=width, bitorder="little")


def literal_counts(block: Block, width: int) -> np.ndarray:
    """Rows, with multiplicity, that meet each of the 2n literals exactly."""
    counts = np.zeros(2 * width, dtype=np.int64)
    for start in range(0, len(block), 8192):
        part = block.take(slice(start, start + 8192))
        one = unpack(part.ones, width).astype(bool)
        zero = ~one if part.halves is None else ~(one | unpack(part.halves, width).astype(bool))
        counts[:width] += part.mult @ one
        counts[width:] += part.mult @ zero
    return counts


def _digits(mult: np.ndarray, bits: int = DIGIT_BITS):
    """Multiplicities as digits of so many bits: ``(shift, digit array)`` from low to high."""
    shift, rest = 0, mult
    while rest.any():
        digit = (rest & ((1 << bits) - 1)).astype(np.float64)
        if digit.any():
            yield shift, digit
        rest = rest >> bits
        shift += bits


def _whole_sum(row_weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``row_weight @ values`` as Python integers, exact for whole values below 2**53."""
    high = np.floor(values * 2.0**-26)
    low = values - high * 2.0**26
    return _integers(row_weight @ high) * (1 << 26) + _integers(row_weight @ low)


def _integers(values: np.ndarray) -> np.ndarray:
    return np.rint(values).astype(np.int64).astype(object)


def _products(pos: Block, neg: Block):
    """The two rectangles that hold every pair with at least one flagged row."""
    yield pos.take(pos.flag), neg
    yield pos.take(~pos.flag), neg.take(neg.flag)


def _tiles(pos: Block, neg: Block):
    for left, right in _products(pos, neg):
        for i in range(0, len(left), TILE):
            for j in range(0, len(right), TILE):
                yield left.take(slice(i, i + TILE)), right.take(slice(j, j + TILE))


def _flat_tiles(pos: Block, neg: Block, width: int):
    """Tiles of rows without uncertain values, as 0/1 matrices of the features that count.

    ``(left, p, right, n, shared)``: ``p`` has a row per row of ``left``, ``n`` a
    column per row of ``right`` and a row per feature of ``shared``, those that occur
    on both sides, then a row of ones and the row of sizes. A feature that is not
    shared cannot make two rows alike in a one.
    """
    high, wide = max(1, TILE // FLAT_HIGH), TILE * FLAT_WIDE
    for j in range(0, len(neg), wide):
        right = neg.take(slice(j, j + wide))
        bits = unpack(right.ones, width)
        used = np.flatnonzero(bits.any(axis=0))
        n = np.vstack([bits[:, used].T, np.ones(len(right)), _sizes(right)]).astype(np.float32)
        for i in range(0, len(pos), high):
            left = pos.take(slice(i, i + high))
            p = unpack(left.ones, width)
            at = np.flatnonzero(p.any(axis=0)[used])
            yield left, p, right, n[np.append(at, [len(used), len(used) + 1])], used[at]


def _flat_gap(p: np.ndarray, a: np.ndarray, n: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """``a + scale * b - 2 p.n`` in one product, for the sizes a and b of both sides."""
    return np.column_stack([-2.0 * p, a, np.full(len(p), scale)]).astype(np.float32) @ n


def _sizes(block: Block) -> np.ndarray:
    """Ones of each row."""
    return np.bitwise_count(block.ones.view(np.uint64)).sum(axis=1, dtype=np.int64)


def relevance_sum(pos: Block, neg: Block, rule: Rule) -> np.ndarray:
    """Relevance units of the 2n literals, then their second sums if the rule has
    them, over pairs with a flagged row."""
    total = np.zeros(rule.sums, dtype=object)
    if rule.halves is None:
        for left, right in _products(pos, neg):
            total += _certain_sum(left, right, rule.width)
        return total
    tile = _fine_tile if rule.fine else _uncertain_tile
    for left, right in _tiles(pos, neg):
        total += tile(left, right, rule)
    return total


def _certain_sum(pos: Block, neg: Block, width: int) -> np.ndarray:
    """Relevance units over all pairs of rows without uncertain values.

    A literal that wants a one gets all pairs of its positives less those whose
    negative has the one too, and the other way round for a zero. So only features
    that both sides of a tile have take part in products.
    """
    total = np.zeros(2 * width, dtype=object)
    grouped = min(len(pos), len(neg)) >= GROUP_ROWS
    step = min(PIECE, max(TILE, PIECE_BITS // width))
    for j in range(0, len(neg), step):
        right = _piece(neg.take(slice(j, j + step)), width, grouped)
        for i in range(0, len(pos), step):
            total += _piece_sum(_piece(pos.take(slice(i, i + step)), width, grouped), right, width)
    return total


@dataclass(frozen=True)
class _Piece:
    """Rows as a matrix with a row per feature, rows alike side by side in ``groups``."""

    mult: np.ndarray
    sizes: np.ndarray
    bits: np.ndarray
    groups: list[tuple[int, int]]

    def found(self, start: int, end: int, features=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Where the ones of some rows are: the places of features and of rows, by feature."""
        at = np.flatnonzero(self.bits[features, start:end])
        feature = at // (end - start)
        return feature, at - feature * (end - start)

    def counts(self, start: int, end: int) -> np.ndarray:
        return np.bincount(self.found(start, end)[0], minlength=len(self.bits))

    def per_feature(self, values: np.ndarray) -> np.ndarray:
        """Whole numbers of rows, a column each, added up for the features the rows have."""
        total = np.zeros((len(self.bits), values.shape[1]), dtype=np.int64)
        for i in range(0, len(values), TILE):
            total += (self.bits[:, i : i + TILE].astype(np.float64) @ values[i : i + TILE]).astype(np.int64)
        return total


def _piece(block: Block, width: int, grouped: bool) -> _Piece:
    groups = [(0, len(block))]
    if grouped:
        group = _groups(block, width)
        # Rows that occur often stand together: few tiles have a second digit.
        block = block.take(np.lexsort((block.mult, group)))
        ends = np.cumsum(np.bincount(group)).tolist()
        groups = [(s, e) for s, e in zip([0, *ends], ends) if s < e]
    bits = np.empty((width, len(block)), dtype=bool)
    for i in range(0, len(block), TILE):
        bits[:, i : i + TILE] = unpack(block.ones[i : i + TILE], width).T
    return _Piece(block.mult, _sizes(block), bits, groups)


def _groups(block: Block, width: int) -> np.ndarray:
    """A group for every row, so that rows of a group have many features in common.

    Centres move a few times among evenly spaced rows, then every row goes to the
    nearest one. Groups decide in which tile a pair is added up, not what it adds.
    """
    rows = len(block)
    count = min(GROUPS, rows // GROUP_ROWS)
    if count < 2:
        return np.zeros(rows, dtype=np.intp)
    probe = unpack(block.ones[:: max(1, rows // (GROUP_PROBES * count))], width)
    often = probe.sum(axis=0, dtype=np.int64)
    telling = np.argsort(-often * (len(probe) - often), kind="stable")[:GROUP_FEATURES]

    def nearest(values: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(axis=1) - 2.0 * values @ centres.T).argmin(axis=1)

    probe = probe[:, telling].astype(np.float32)
    centres = probe[np.linspace(0, len(probe) - 1, count).astype(np.intp)]
    for _ in range(GROUP_MOVES):
        own = nearest(probe)
        centres = np.stack([probe[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(count)])
    parts = [unpack(block.ones[i : i + TILE], width)[:, telling] for i in range(0, rows, TILE)]
    return np.concatenate([nearest(part.astype(np.float32)) for part in parts])


def _piece_sum(left: _Piece, right: _Piece, width: int) -> np.ndarray:
    """:func:`_certain_sum` of two pieces."""
    sums = _Parts(width)  # of pairs that both have a feature
    left_rows, right_rows = _Parts(len(left.mult)), _Parts(len(right.mult))
    group_counts = [left.counts(*group) for group in left.groups]
    for start, end in _chunks(right.groups, TILE * FLAT_WIDE):
        negatives = slice(start, end)
        n_count = right.counts(start, end)
        for group, p_count in zip(left.groups, group_counts):
            chosen = _plan(p_count, n_count, group[1] - group[0], end - start)
            _group_sum(left, slice(*group), right, negatives, chosen, sums, left_rows, right_rows)
    total = np.zeros(2 * width, dtype=object)
    ones, zeros = total[:width], total[width:]
    for literals, side, rows in ((ones, left, left_rows), (zeros, right, right_rows)):
        for shift, parts in rows.held.items():
            for own_shift, digit in _digits(side.mult, FLAT_DIGIT_BITS):
                _add_parts(literals, shift + own_shift, side.per_feature(_carried(parts).T * digit[:, None]).T)
        for shift, parts in sums.held.items():
            _add_parts(literals, shift, -parts)
    return total


class _Parts:
    """Whole numbers as multiples of 2**26 and the rest, by the shift of the digits they were made with."""

    def __init__(self, size: int):
        self.size = size
        self.held: dict[int, np.ndarray] = {}

    def at(self, shift: int) -> np.ndarray:
        return self.held.setdefault(shift, np.zeros((2, self.size), dtype=np.int64))


def _carried(parts: np.ndarray) -> np.ndarray:
    return np.stack([parts[0] + (parts[1] >> 26), parts[1] & ((1 << 26) - 1)])


def _add_parts(total: np.ndarray, shift: int, parts: np.ndarray) -> None:
    total += parts[0].astype(object) * (1 << (26 + shift)) + parts[1].astype(object) * (1 << shift)


@dataclass(frozen=True)
class _Plan:
    """How the features that both sides of a tile have are dealt with.

    ``dense`` ones are multiplied as matrices. For the others few pairs are (1, 1), or
    few are (0, 1), (1, 0) or (0, 0) where nearly all rows of a side have the feature:
    those pairs are listed, and all pairs follow from the rows. ``left_zero`` and
    ``right_zero`` tell which value is the listed one.
    """

    dense: np.ndarray
    listed: np.ndarray
    left_zero: np.ndarray
    right_zero: np.ndarray

    @property
    def sign(self) -> np.ndarray:
        """1 where a listed pair adds to the pairs that have the feature, else -1."""
        return np.where(self.left_zero == self.right_zero, 1.0, -1.0)


def _plan(p_count: np.ndarray, n_count: np.ndarray, high: int, wide: int) -> _Plan:
    used = np.flatnonzero((p_count > 0) & (n_count > 0))
    p, n = p_count[used], n_count[used]
    kinds = np.stack([p * n, (high - p) * n, p * (wide - n), (high - p) * (wide - n)])
    kind = kinds.argmin(axis=0)
    dense = kinds.min(axis=0) * RARE > high * wide
    listed, kind = used[~dense], kind[~dense]
    return _Plan(used[dense], listed, kind % 2 == 1, kind >= 2)


def _group_sum(
    left: _Piece, group: slice, right: _Piece, tile: slice, plan: _Plan,
    sums: _Parts, left_rows: _Parts, right_rows: _Parts,
) -> None:
    """Adds all pairs of a group of positives and a tile of negatives."""
    dense, size, wide = plan.dense, len(plan.dense), tile.stop - tile.start
    width = len(left.bits)
    by_left, by_right = plan.listed[plan.right_zero], plan.listed[plan.left_zero]
    neither = plan.listed[plan.left_zero & plan.right_zero]
    # |p| + |n| - 2 p.n, less what all pairs share by the features that are not listed as (1, 1).
    left_sizes = left.sizes[group] - 2 * left.bits[by_left, group].sum(axis=0) + 2 * len(neither)
    right_sizes = right.sizes[tile] - 2 * right.bits[by_right, tile].sum(axis=0)
    # A row per feature, then a row of ones and the row of sizes.
    n = np.empty((size + 2, wide), dtype=np.float32)
    n[:size], n[size], n[size + 1] = right.bits[dense, tile], 1.0, right_sizes
    values = [(shift, digit, n[: size + 1] * digit) for shift, digit in _digits(right.mult[tile], FLAT_DIGIT_BITS)]
    at = np.flatnonzero(right.bits[plan.listed, tile] != plan.right_zero[:, None])
    n_rows, n_ends = at % wide, np.searchsorted(at, np.arange(1, len(plan.listed) + 1) * wide)
    n_count = np.diff(n_ends, prepend=0)
    row_sums, column_sums = _Parts(group.stop - group.start), _Parts(wide)
    # A narrow tile is high instead, as far as sums of its columns are exact too.
    most = min(TILE * FLAT_WIDE, max(1, TILE // FLAT_HIGH, TILE * TILE // wide))
    for start, end in _chunks([(group.start, group.stop)], most):
        high, own_rows = end - start, slice(start - group.start, end - group.start)
        own = left.bits[dense, start:end].astype(np.float32)
        gap = _flat_gap(own.T, left_sizes[own_rows], n)
        # The listed pairs, by feature and positive.
        at = np.flatnonzero(left.bits[plan.listed, start:end] != plan.left_zero[:, None])
        at = at[n_count[at // high] > 0]
        feature = at // high
        row, times = at - feature * high, n_count[feature]
        firsts = np.cumsum(times) - times
        met = n_rows[np.repeat(n_ends[feature] - times - firsts, times) + np.arange(times.sum())]
        pairs = np.repeat(row * wide, times) + met
        sign = plan.sign[feature]
        np.subtract.at(gap.reshape(-1), pairs, np.repeat((2.0 * sign).astype(np.float32), times))
        weight = _share(gap)
        left_digits = list(_digits(left.mult[start:end], FLAT_DIGIT_BITS))
        for left_shift, digit in left_digits:
            column_sums.at(left_shift)[:] += _halved(digit @ weight).astype(np.int64)
        listed = weight.reshape(-1)[pairs]
        for right_shift, right_digit, weighted in values:
            product = weighted @ weight.T
            row_sums.at(right_shift)[:, own_rows] += _halved(product[size]).astype(np.int64)
            shared = _halved(product[:size]) * own
            few = _halved(np.add.reduceat(listed * right_digit[met], firsts)) * sign if len(pairs) else ()
            for left_shift, digit in left_digits:
                found = sums.at(left_shift + right_shift)
                found[:, dense] += (shared @ digit).astype(np.int64)
                for total, part in zip(found, few):
                    total[plan.listed] += np.bincount(feature, part * digit[row], len(plan.listed)).astype(np.int64)
    # What all pairs of a row give the features that are not listed as (1, 1).
    for piece, rows, features, own_sums, all_sums in (
        (left, group, by_left, row_sums, left_rows), (right, tile, by_right, column_sums, right_rows)
    ):
        for shift, parts in own_sums.held.items():
            all_sums.at(shift)[:, rows] += parts
            for own_shift, digit in _digits(piece.mult[rows], FLAT_DIGIT_BITS):
                given = _carried(parts) * digit
                found = sums.at(shift + own_shift)
                found[:, features] += (given @ piece.bits[features, rows].T).astype(np.int64)
                if piece is left:
                    found[:, neither] -= given.sum(axis=1).astype(np.int64)[:, None]


def _chunks(groups: list[tuple[int, int]], size: int):
    """Every group, at most ``size`` rows at a time."""
    for start, end in groups:
        for i in range(start, end, size):
            yield i, min(i + size, end)


def _halved(values: np.ndarray) -> np.ndarray:
    """Whole values below 2**53 as multiples of 2**26, and the rest."""
    high = np.floor(values * 2.0**-26)
    return np.stack([high, values - high * 2.0**26])


def distance_counts(pos: Block, neg: Block, width: int) -> np.ndarray:
    """Pairs with a flagged row, with multiplicity, at each distance 0..n.

    An uncertain value differs from a certain one and not from another uncertain one.
    """
    total = np.zeros(width + 1, dtype=object)
    if pos.halves is None:
        for left, right in _products(pos, neg):
            # Tiles of rows alike in size have few distances; rows that occur once are counted faster.
            for p, p_rows, n, n_rows in _flat_distance_tiles(_by_size(left), _by_size(right), width):
                found = _paired_counts if p_rows.mult.max() == n_rows.mult.max() == 1 else _flat_counts
                counts = found(p, p_rows, n, n_rows)
                total[: len(counts)] += counts[: width + 1]
        return total
    for left, right in _tiles(pos, neg):
        gap = _distances(left, right, width)
        total += _weighted_counts(gap, left.mult, right.mult, width + 1)
    return total


def _by_size(block: Block) -> Block:
    return block.take(np.lexsort((_sizes(block), block.mult > 1)))


def _flat_distance_tiles(pos: Block, neg: Block, width: int):
    for left, p, right, n, shared in _flat_tiles(pos, neg, width):
        yield p[:, shared].astype(np.float32), left, n, right


def _weighted_counts(gap: np.ndarray, left_mult, right_mult, size: int) -> np.ndarray:
    total = np.zeros(size, dtype=object)
    for right_shift, right_digit in _digits(right_mult):
        for left_shift, left_digit in _digits(left_mult):
            weight = np.outer(left_digit, right_digit).ravel()
            found = np.bincount(gap.ravel(), weights=weight, minlength=size)
            total += _integers(found) * (1 << (left_shift + right_shift))
    return total


def _flat_counts(p: np.ndarray, left: Block, n: np.ndarray, right: Block) -> np.ndarray:
    sizes = _sizes(left)
    gap = _flat_gap(p, sizes, n).astype(np.intp)
    return _weighted_counts(gap, left.mult, right.mult, int(sizes.max() + n[-1].max()) + 1)


def _paired_counts(p: np.ndarray, left: Block, n: np.ndarray, right: Block) -> np.ndarray:
    """Pairs at each distance where every row occurs once.

    Two rows of ``p`` are one row of the product: with B above every distance, d + B e
    is one whole number for the distances d of the first and e of the second.
    """
    a = _sizes(left)
    size = int(a.max() + n[-1].max()) + 1
    half = len(p) // 2
    if size * size > PAIRED_BINS:
        half = 0

    def counted(gap: np.ndarray, bins: int) -> np.ndarray:
        return np.bincount(gap.astype(np.intp).ravel(), minlength=bins)

    total = counted(_flat_gap(p[2 * half :], a[2 * half :], n), size)
    if half:
        first, second = slice(0, half), slice(half, 2 * half)
        gap = _flat_gap(p[first] + size * p[second], a[first] + size * a[second], n, 1.0 + size)
        both = counted(gap, size * size).reshape(size, size)
        total += both.sum(axis=0) + both.sum(axis=1)
    return total


def distance_rows(pos: Block, neg: Block, width: int) -> np.ndarray:
    """Of every row of ``neg`` the rows of ``pos``, with multiplicity, at each distance 0..n."""
    total = np.zeros((len(neg), width + 1), dtype=np.int64)
    for i in range(0, len(neg), TILE):
        right = neg.take(slice(i, i + TILE))
        own = np.arange(len(right)) * (width + 1)
        for j in range(0, len(pos), TILE):
            left = pos.take(slice(j, j + TILE))
            cells = (own + _distances(left, right, width)).ravel()
            for shift, digit in _digits(left.mult):
                found = np.bincount(
                    cells, weights=np.repeat(digit, len(right)), minlength=len(right) * (width + 1)
                )
                total[i : i + TILE] += found.astype(np.int64).reshape(len(right), -1) << shift
    return total


def _distances(left: Block, right: Block, width: int) -> np.ndarray:
    """Differing features of every pair of rows."""
    p, n = unpack(left.ones, width), unpack(right.ones, width)
    gap = _gap(p.astype(np.float32), n.astype(np.float32))
    if left.halves is not None:
        ph = unpack(left.halves, width).astype(np.float32)
        nh = unpack(right.halves, width).astype(np.float32)
        # An uncertain value counts as 0 above: right against 1, not against 0.
        gap = gap + ph @ (1.0 - n - nh).T + (1.0 - p - ph) @ nh.T
    return gap.astype(np.intp)


def coefficient_counts(pos: Block, neg: Block, width: int) -> Counter:
    """Pairs with a flagged row, with multiplicity, by what they give a literal.

    A pair of c certain and m uncertain differences gives 1 / (c + m u) to a literal
    it tells apart for certain, u / (c + m u) where one of the two values is
    uncertain, and half of that where both are. Counted under (literal, c, m) are the
    first as ``full`` and the others as ``part``, in halves; u is in neither.
    """
    total: Counter = Counter()
    for left, right in _tiles(pos, neg):
        total.update(_coefficient_tile(left, right, width))
    return total


def _coefficient_tile(pos: Block, neg: Block, width: int) -> dict:
    def planes(block: Block):
        one = unpack(block.ones, width)
        half = np.zeros_like(one) if block.halves is None else unpack(block.halves, width)
        return [x.astype(np.float32) for x in (one, 1 - one - half, half)]

    (p1, p0, ph), (n1, n0, nh) = planes(pos), planes(neg)
    certain = p1 @ n0.T + p0 @ n1.T
    unsure = ph.sum(1)[:, None] + nh.sum(1)[None, :] - ph @ nh.T
    kinds, kind = np.unique((certain * (width + 1) + unsure).astype(np.intp), return_inverse=True)
    kind = kind.reshape(len(pos), len(neg))
    found: dict = {}
    for right_shift, right_digit in _digits(neg.mult):
        for left_shift, left_digit in _digits(pos.mult):
            scale = 1 << (left_shift + right_shift)
            for literal in range(2 * width):
                k = literal % width
                a, b = (p1, n0) if literal < width else (p0, n1)
                # Of a pair (value, other value): wanted and not, wanted and unsure, unsure and not, both unsure.
                for name, left, right, halves in (
                    ("full", a, b, 1), ("part", a, nh, 2), ("part", ph, b, 2), ("part", ph, nh, 1),
                ):
                    rows, columns = np.flatnonzero(left[:, k]), np.flatnonzero(right[:, k])
                    if not len(rows) or not len(columns):
                        continue
                    weight = np.outer(left_digit[rows], right_digit[columns]).ravel()
                    sums = np.bincount(kind[np.ix_(rows, columns)].ravel(), weights=weight, minlength=len(kinds))
                    for at in np.flatnonzero(sums):
                        key = (literal, *divmod(int(kinds[at]), width + 1), name)
                        found[key] = found.get(key, 0) + int(sums[at]) * halves * scale
    return found


def _gap(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions where row i of ``p`` and row j of ``n`` differ, in one product.

    |p| + |n| - 2 p.n, with the two row sums carried as extra columns.
    """
    left = np.column_stack([-2.0 * p, p.sum(1), np.ones(len(p))]).astype(np.float32)
    right = np.column_stack([n, np.ones(len(n)), n.sum(1)]).astype(np.float32)
    return left @ right.T


def _share(gap: np.ndarray, bits: int = UNIT_BITS) -> np.ndarray:
    """round(2**bits / gap), with nothing where the gap is 0."""
    none = gap == 0.0 if gap.min() == 0.0 else None
    weight = gap.astype(np.float64)
    with np.errstate(divide="ignore"):
        np.divide(2.0**bits, weight, out=weight)
    if none is not None:
        weight[none] = 0.0
    return np.rint(weight, out=weight)


def _uncertain_tile(pos: Block, neg: Block, rule: Rule) -> np.ndarray:
    width = rule.width
    p1 = unpack(pos.ones, width).astype(np.float32)
    n1 = unpack(neg.ones, width).astype(np.float32)
    total = np.zeros(rule.sums, dtype=object)
    ph = unpack(pos.halves, width).astype(np.float32)
    nh = unpack(neg.halves, width).astype(np.float32)
    p0, n0 = 1.0 - p1 - ph, 1.0 - n1 - nh
    certain = p1 @ n0.T + p0 @ n1.T
    both_half = ph @ nh.T
    touched = ph.sum(1)[:, None] + nh.sum(1)[None, :]
    loose = None
    if rule.halves == "distance":
        weight = _share(certain + touched - 2.0 * both_half)
        per_unsure = None
    else:
        unsure = touched - both_half
        weight = _share(certain)
        loose = np.where(certain == 0.0, _share(unsure, UNIT_BITS - 1), 0.0)
        # 1 / (c + m u) = 1 / c - u m / c**2 + ...
        per_unsure = _share(certain, SECOND_BITS - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            less = np.rint(unsure * 2.0**SECOND_BITS / certain.astype(np.float64) ** 2)
        less = np.where(certain == 0.0, 0.0, less)
    for right_shift, right_digit in _digits(neg.mult):
        r1, r0, rh = (m * right_digit[:, None] for m in (n1, n0, nh))
        wants_one, wants_zero = p1 * (weight @ r0), p0 * (weight @ r1)
        if loose is not None and loose.any():
            h1, h0, hh = loose @ r1, loose @ r0, loose @ rh
            wants_one = wants_one + 2.0 * (p1 * hh + ph * h0) + ph * hh
            wants_zero = wants_zero + 2.0 * (p0 * hh + ph * h1) + ph * hh
        sums = [wants_one, wants_zero]
        if per_unsure is not None:
            h1, h0, hh = per_unsure @ r1, per_unsure @ r0, per_unsure @ rh
            shared = ph * hh
            sums.append(2.0 * (p1 * hh + ph * h0) + shared - p1 * (less @ r0))
            sums.append(2.0 * (p0 * hh + ph * h1) + shared - p0 * (less @ r1))
        for left_shift, left_digit in _digits(pos.mult):
            scale = 1 << (left_shift + right_shift)
            for i, values in enumerate(sums):
                total[i * width : (i + 1) * width] += _whole_sum(left_digit, values) * scale
    return total


def _fine_tile(pos: Block, neg: Block, rule: Rule) -> np.ndarray:
    """The few-rows case, in whole numbers of 2**-90 with u = 2**-(p+q) counted in."""
    width, one_unit = rule.width, 1 << rule.rows
    total = np.zeros(2 * width, dtype=object)
    p1, ph = unpack(pos.ones, width).astype(bool), unpack(pos.halves, width).astype(bool)
    n1, nh = unpack(neg.ones, width).astype(bool), unpack(neg.halves, width).astype(bool)
    for i in range(len(pos)):
        for j in range(len(neg)):
            a1, ah, b1, bh = p1[i], ph[i], n1[j], nh[j]
            a0, b0 = ~(a1 | ah), ~(b1 | bh)
            certain = int((a1 & b0).sum() + (a0 & b1).sum())
            unsure = int((ah | bh).sum())
            distance = certain * one_unit + unsure
            if distance == 0:
                continue
            pairs = int(pos.mult[i]) * int(neg.mult[j])

            def share(half_units: int) -> int:
                scaled = pairs * half_units << FINE_BITS
                return (scaled + distance) // (2 * distance)

            full, part, split = share(2 * one_unit), share(2), share(1)
            total[:width][a1 & b0] += full
            total[width:][a0 & b1] += full
            total[:width][(a1 & bh) | (ah & b0)] += part
            total[width:][(a0 & bh) | (ah & b1)] += part
            total[:width][ah & bh] += split
            total[width:][ah & bh] += split
    return total
