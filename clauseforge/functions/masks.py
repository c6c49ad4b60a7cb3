"""Vectors as machine words, and conjunctions as word masks.

Feature ``k`` lives in bit ``k % 64`` of word ``k // 64``. A packed row has the
columns ``w0, w1, ...`` ("the value is 1") and, where a table holds uncertain
values, ``h0, h1, ...`` ("the value is 0.5").
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def word_count(width: int) -> int:
    return -(-width // WORD)


def one_columns(width: int) -> list[str]:
    return [f"w{i}" for i in range(word_count(width))]


def half_columns(width: int) -> list[str]:
    return [f"h{i}" for i in range(word_count(width))]


def pack_word(features: Column, index: int, value: float) -> Column:
    """Word ``index`` of the "feature equals ``value``" bit set, as a bigint."""
    chunk = F.reverse(F.slice(features, index * WORD + 1, WORD))
    return F.aggregate(
        chunk,
        F.lit(0).cast("bigint"),
        lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x == F.lit(value)).cast("bigint")),
    )


def bit_string(width: int) -> Column:
    """A packed 0/1 row as a string of 0 and 1 in feature order."""
    return word_text(one_columns(width), width)


def word_text(columns: list[str], width: int) -> Column:
    """The bits of word columns as text, in feature order."""
    parts = [F.reverse(F.lpad(F.bin(F.col(c)), WORD, "0")) for c in columns]
    return F.substring(F.concat(*parts), 1, width)


def _signed(word: int) -> int:
    return word - (1 << WORD) if word >> (WORD - 1) else word


def _big(word: int) -> str:
    """A bigint literal; the lowest value has no literal of its own."""
    return f"{word}L" if word > -(1 << (WORD - 1)) else "(-9223372036854775807L - 1L)"


@dataclass(frozen=True)
class Mask:
    """A conjunction: bits that must be 1 (``ones``) and bits that must be 0 (``zeros``)."""

    ones: tuple[int, ...]
    zeros: tuple[int, ...]

    @staticmethod
    def empty(width: int) -> Mask:
        return Mask((0,) * word_count(width), (0,) * word_count(width))

    @staticmethod
    def of(term: dict[int, int], width: int) -> Mask:
        """From ``{feature: wanted value}``."""
        words = {0: [0] * word_count(width), 1: [0] * word_count(width)}
        for feature, want in term.items():
            words[want][feature // WORD] |= 1 << (feature % WORD)
        return Mask(tuple(words[1]), tuple(words[0]))

    def _pairs(self):
        return [
            (i, _signed(one), _signed(zero))
            for i, (one, zero) in enumerate(zip(self.ones, self.zeros))
            if one or zero
        ]

    def exact(self, halves: bool) -> Column:
        """True where every literal is met exactly (an uncertain value meets none)."""
        tests = []
        for i, one, zero in self._pairs():
            if one:
                tests.append(f"(w{i} & {_big(one)}) = {_big(one)}")
            if zero:
                known = f"(w{i} | h{i})" if halves else f"w{i}"
                tests.append(f"({known} & {_big(zero)}) = 0")
        return F.expr(" AND ".join(tests) or "true")

    def allows(self, halves: bool) -> Column:
        """True where no literal is contradicted (an uncertain value contradicts none)."""
        tests = []
        for i, one, zero in self._pairs():
            if one:
                possible = f"(w{i} | h{i})" if halves else f"w{i}"
                tests.append(f"({possible} & {_big(one)}) = {_big(one)}")
            if zero:
                tests.append(f"(w{i} & {_big(zero)}) = 0")
        return F.expr(" AND ".join(tests) or "true")

    def exact_rows(self, ones: np.ndarray, halves: np.ndarray | None) -> np.ndarray:
        """:meth:`exact` over word arrays."""
        keep = np.ones(len(ones), dtype=bool)
        for i, one, zero in self._pairs():
            w = ones[:, i]
            known = w if halves is None else w | halves[:, i]
            keep &= ((w & np.int64(one)) == one) & ((known & np.int64(zero)) == 0)
        return keep

    def allows_rows(self, ones: np.ndarray, halves: np.ndarray | None) -> np.ndarray:
        """:meth:`allows` over word arrays."""
        keep = np.ones(len(ones), dtype=bool)
        for i, one, zero in self._pairs():
            w = ones[:, i]
            possible = w if halves is None else w | halves[:, i]
            keep &= ((possible & np.int64(one)) == one) & ((w & np.int64(zero)) == 0)
        return keep
