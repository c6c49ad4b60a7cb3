"""Hashes of words and of word windows, inside tasks."""

from __future__ import annotations

# Words whose hashes one worker keeps within a task, and the longest of them in bytes;
# a full table, of some 20 MB then, is emptied and filled anew.
WORDS_KEPT, LONGEST_KEPT = 100_000, 32

_kept: dict[bytes, int] = {}

# Odd multipliers, one for each place of a window.
_PLACES = (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
    0xA0761D6478BD642F,
)


def giving_back(task):
    """``task``, after whose last batch the worker keeps no words and no unused memory.

    Workers stay beside the executor while other stages run, and count as its memory.
    """

    def run(batches):
        yield from task(batches)
        give_back()

    return run


def give_back() -> None:
    import pyarrow as pa

    _kept.clear()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def words_of(text: str, lower: bool = False) -> list[bytes]:
    """Runs of characters other than ASCII white space; ``lower`` turns A-Z small."""
    raw = text.encode()
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]):
    """64-bit hashes, the same in every worker."""
    import numpy as np
    import xxhash

    missing = set(words).difference(_kept)
    if missing:
        if len(_kept) + len(missing) > WORDS_KEPT:
            _kept.clear()
            missing = set(words)
        digest = xxhash.xxh3_64_intdigest
        _kept.update((w, digest(w)) for w in missing if len(w) <= LONGEST_KEPT)
        if any(len(w) > LONGEST_KEPT for w in missing):
            return np.fromiter((_kept[w] if w in _kept else digest(w) for w in words), "u8", len(words))
    return np.fromiter(map(_kept.__getitem__, words), "u8", len(words))


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: list[bytes], size: int = 5):
    """A hash of every window of ``size`` words; of all words where they are fewer."""
    import numpy as np

    if not words:
        return np.empty(0, "u8")
    size = min(size, len(words))
    hashes = word_hashes(words)
    count = len(hashes) - size + 1
    # Windows of different lengths start from different sums.
    total = np.full(count, size, "u8")
    for place in range(size):
        total += mix(hashes[place : place + count] * np.uint64(_PLACES[place % 5]) + np.uint64(place))
    return mix(total)
