"""Token ids of whole texts inside Arrow tasks.

A text is cut before blanks and line ends that stand alone. No token of the
two vocabularies used here crosses such a place, so the ids of a text are those
of its pieces in order, and a piece met before is looked up instead of encoded
again. Texts with other white space are cut less finely and stay exact.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

# Pieces kept in one worker, twice: when a table is full it becomes the old one,
# from which pieces that are met again move to the new one. Longer pieces are not
# kept, so a table has some 70 MB.
PIECES_KEPT, LONGEST_KEPT = 400_000, 48
# Marks that follow a word as one run, and how many such runs are kept. Not the
# apostrophe, which begins runs of letters, nor what special strings are written with.
MARKS, RUNS_KEPT = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~", 10_000

# White space other than blank and line end, as any of the libraries sees it.
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
_PAIRS = ("  ", "\n\n", " \n", "\n ")
# Places before a lone blank or line end.
_LONE = re.compile(r"(?<=\S)(?=[ \n]\S)")

_loaded: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    """``name`` itself where it is a path, else the installed file of that name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    """The tokenizer of a vocabulary file, once per worker."""
    if name not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[name] = Tokenizer.from_file(tokenizer_path(name))
    return _loaded[name]


def pieces(text: str) -> list[str]:
    """``text`` cut where no token crosses, each piece but the first without its blank.

    A piece that starts with a line end stands for itself, any other but the
    first for itself after a blank. Empty where white space makes this unsafe.
    """
    if any(p in text for p in _PAIRS) or any(c in text for c in _RARE):
        return []
    return text.replace("\n", " \n").split(" ")


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


def _is_latin(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) <= "\xff")


class _Kept(dict):
    """Ids by piece; those of a piece that is not there are taken from ``old``, or made."""

    def __init__(self, make, old: dict[str, bytes]):
        self.make, self.old = make, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        # Long pieces hardly come again.
        if len(piece) <= LONGEST_KEPT:
            self[piece] = ids
        return ids


class IdEncoder:
    """Byte-level ids of texts as little-endian unsigned 32-bit strings.

    A piece that is one word of Latin letters is one token run of the
    vocabulary's splitting rule and goes to its merges directly; marks after
    such a word are a run of their own. All other pieces go through the whole rule.
    """

    def __init__(self, name: str):
        self.tokenizer = load(name)
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.kept = _Kept(self._piece_ids, {})
        self.line_end = self._ids("\n")
        self.runs = {"": b""}

    def _ids(self, text: str) -> bytes:
        encoded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return array("I", encoded[0].ids).tobytes()

    def _word_ids(self, word: str, blank: str) -> bytes:
        """Ids of a word after ``blank``, written as a vocabulary writes them."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merges.tokenize(blank + word)]).tobytes()

    def _run_ids(self, marks: str) -> bytes:
        ids = self.runs.get(marks)
        if ids is None:
            ids = self._ids(marks)
            if len(self.runs) < RUNS_KEPT and len(marks) <= LONGEST_KEPT:
                self.runs[marks] = ids
        return ids

    def _piece_ids(self, piece: str) -> bytes:
        word = piece.rstrip(MARKS)
        if _is_latin(word):
            if len(word) == len(piece):
                return self._word_ids(word, "\u0120")
            return self.kept[word] + self._run_ids(piece[len(word) :])
        first = piece[:1]
        if first == "\r":
            return self._ids(piece[1:])
        if first != "\n":
            return self._ids(" " + piece)
        word = word[1:]
        if not _is_latin(word):
            return self._ids(piece)
        return self.line_end + self._word_ids(word, "") + self._run_ids(piece[1 + len(word) :])

    def encode(self, text: str) -> bytes:
        parts = pieces(text)
        if not parts:
            return b"".join(map(self._ids, _LONE.split(text)))
        # The first piece has no blank; no other begins with this character.
        parts[0] = "\r" + parts[0]
        if len(self.kept) > PIECES_KEPT:
            self.kept = _Kept(self._piece_ids, dict(self.kept))
        return b"".join(map(self.kept.__getitem__, parts))


def _forget_long(kept: dict, pieces: Iterable[str]) -> None:
    """Long pieces hardly come again."""
    for piece in [p for p in pieces if len(p) > LONGEST_KEPT]:
        del kept[piece]


class PieceCounter:
    """Numbers of tokens, for vocabularies that drop white space."""

    def __init__(self, name: str):
        self.tokenizer = load(name)
        self.kept: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count(self, text: str) -> int:
        # Blanks and line ends are dropped and end every token.
        parts, kept = text.replace("\n", " ").split(" "), self.kept
        missing = set(parts).difference(kept)
        if missing:
            if len(kept) > PIECES_KEPT:
                self.old, self.kept = kept, {}
                kept, missing = self.kept, set(parts)
            old = self.old
            kept.update((p, old[p]) for p in missing if p in old)
            missing = [p for p in missing if p not in old]
            encoded = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
            kept.update((p, len(got.ids)) for p, got in zip(missing, encoded))
        out = sum(map(kept.__getitem__, parts))
        _forget_long(kept, missing)
        return out


_encoders: dict[tuple[type, str], object] = {}


def _worker(kind: type, name: str):
    if (kind, name) not in _encoders:
        _encoders[kind, name] = kind(name)
    return _encoders[kind, name]


def id_encoder(name: str) -> IdEncoder:
    """One encoder per worker, so that its pieces serve every task of the worker."""
    return _worker(IdEncoder, name)


def piece_counter(name: str) -> PieceCounter:
    return _worker(PieceCounter, name)


def rows_of(batch, *names: str) -> Iterable[tuple]:
    """The rows of an Arrow batch; one column at a time is turned into Python."""
    return zip(*[batch.column(n).to_pylist() for n in names])
