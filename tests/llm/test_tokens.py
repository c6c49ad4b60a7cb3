import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from clauseforge.llm import binary, counts, packing, tokens
from clauseforge.llm.queries import BYTE_BPE, WORD_BPE
from odd import by_row, empty_documents, odd_documents, odd_rows


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(tokens.tokenizer_path(BYTE_BPE))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


ALPHABET = [
    "a", "B", "word", " ", " ", "\n", "\t", "'s", "'", "é", "é", "<|endoftext|>", "\xa0", "\x1c", "\x85",
    "9", "!", ",", ".", "İ", "Σ", "ǆ", "漢", "\r\n", " ", "<", "|>", "😀", "_", "ª", "\x00",
]


@pytest.mark.parametrize("kept", [20, 400_000])
def test_pieces_give_the_ids_of_whole_texts(byte_bpe, kept, monkeypatch):
    monkeypatch.setattr(tokens, "PIECES_KEPT", kept)
    words = Tokenizer.from_file(tokens.tokenizer_path(WORD_BPE))
    encoder, counter = tokens.IdEncoder(BYTE_BPE), tokens.PieceCounter(WORD_BPE)
    rng = random.Random(kept)
    for _ in range(4000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(16)))
        got = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert got == byte_bpe.encode(text, add_special_tokens=False).ids, repr(text)
        assert counter.count(text) == len(words.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("kind", ["small", "wide", "same", "outliers"])
def test_block_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "small": rng.integers(0, 7, n), "wide": rng.integers(0, 2**32, n),
        "same": np.full(n, 50256), "outliers": np.where(rng.random(n) < 0.02, 2**32 - 1, 3),
    }[kind].astype("<u4")
    payload = binary.write_file([5, None], [n, 0], ids)
    doc_ids, lengths, back = binary.read_file(payload)
    assert doc_ids == [5, None] and lengths.tolist() == [n, 0] and (back == ids).all()
    for start, length in [(0, n), (n // 2, n - n // 2), (n // 3, min(5, n - n // 3))]:
        assert (binary.read_ids(payload, start, length) == ids[start : start + length]).all()


def test_outliers_are_exceptions():
    ids = np.full(1024, 3, "<u4")
    ids[::100] = 60_000
    blocks, sizes = binary.pack_blocks(ids)
    assert sizes[0] < 100


def expected_files(byte_bpe):
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    start, out = 0, []
    for doc_id, text in rows:
        ids = ids_of(byte_bpe, text)
        out.append((doc_id, len(ids), crc(ids)))
        start += len(ids)
    return sorted(out, key=repr), start


def test_token_files(spark, byte_bpe):
    files = binary.token_files(odd_documents(spark), BYTE_BPE)
    got = binary.read_documents(files).collect()
    expected, total = expected_files(byte_bpe)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == expected
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sum(r.n_tokens for r in got) == total
    assert binary.read_documents(binary.token_files(empty_documents(spark), BYTE_BPE)).count() == 0


def check_packing(rows, texts, byte_bpe, capacity):
    """Pieces are the documents, and sequences are filled without gaps or overlap."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts:
        ids = ids_of(byte_bpe, text)
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids) and all(r.length == capacity for r in own[1:])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        room = min((b for b in bins if b >= length), default=None)
        if room is None:
            bins.append(capacity - length)
        else:
            bins.remove(room)
            bins.append(room - length)
    return len(bins)


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packing(spark, byte_bpe, capacity):
    rng = random.Random(capacity)
    texts = [(i, "ab c " * rng.randrange(0, 80)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    rows = packing.pack(docs, BYTE_BPE, capacity).collect()
    made = check_packing(rows, texts, byte_bpe, capacity)
    assert made == best_fit([r.length for r in rows], capacity)


def test_packing_in_many_buckets(spark, byte_bpe, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 10)
    texts = [(i, "same text here" if i % 3 else "other") for i in range(500)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(7)
    check_packing(packing.pack(docs, BYTE_BPE, 16).collect(), texts, byte_bpe, 16)


def test_packing_odd_rows(spark, byte_bpe):
    rows = packing.pack(odd_documents(spark), BYTE_BPE).collect()
    total = sum(len(ids_of(byte_bpe, t)) for _, t in odd_rows())
    assert sum(r.length for r in rows) == total
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for a, b in zip(places, places[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)
    assert packing.pack(empty_documents(spark), BYTE_BPE).count() == 0


def test_sequences_hold_the_ids(spark, byte_bpe):
    texts = [(i, "some words " * i) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    made = packing.sequences(packing.pack(docs, BYTE_BPE, 32, with_ids=True)).collect()
    assert sorted(i for r in made for i in r.ids) == sorted(i for _, t in texts for i in ids_of(byte_bpe, t))
    assert all(len(r.ids) <= 32 for r in made)


def test_plan_does_not_grow_with_counts():
    small = packing.plan_runs({n: 3 for n in range(1, 2049)}, 2048)
    large = packing.plan_runs({n: 3_000_000_007 for n in range(1, 2049)}, 2048)
    assert len(large) < 20_000 and len(small) < 20_000
    assert sum(r[2] - r[1] for r in large) == 2048 * 3_000_000_007


def test_token_counts_and_cache(spark, tmp_path):
    words = Tokenizer.from_file(tokens.tokenizer_path(WORD_BPE))
    cache = str(tmp_path / "cache")
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = by_row(counts.count_tokens(odd_documents(spark), WORD_BPE, cache), *names)
    expected = []
    for doc_id, text in odd_rows():
        n = len(words.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n, n > 2048))
    assert got == sorted(expected, key=repr)
    stored = spark.read.parquet(cache).count()
    version = hashlib.sha256(open(tokens.tokenizer_path(WORD_BPE), "rb").read()).hexdigest()
    assert {r.version for r in spark.read.parquet(cache).select("version").distinct().collect()} == {version}
    assert stored == counts.read_cache(spark, cache, version).count()
    # Everything is known the second time; one new text is appended.
    again = counts.count_tokens(odd_documents(spark), WORD_BPE, cache)
    assert by_row(again, *names) == got and again.where("NOT from_cache").count() == 0
    assert spark.read.parquet(cache).count() == stored
    more = spark.createDataFrame([(1, "a new text"), (2, "a new  text ")], "doc_id bigint, text string")
    assert by_row(counts.count_tokens(more, WORD_BPE, cache), "n_tokens", "from_cache") == [(3, False), (3, False)]
    assert spark.read.parquet(cache).count() == stored + 1
    assert counts.count_tokens(empty_documents(spark), WORD_BPE, cache).count() == 0


def test_words_with_marks_go_to_the_merges(byte_bpe):
    """Marks after a word are a run of their own and are not encoded with every word."""
    words = [a + b for a in ("Haus", "être", "wood", "ñu", "straße") for b in ("al", "bet", "corn", "dig", "elf")]
    tails = ["&&&", ".%%%", "!!", ",***", "$$$", "...", ")", "-", "_", '"', ",", "'", "'s", "<", "|>", "!'"]
    encoder = tokens.IdEncoder("byte_bpe_50k.json")
    through, rule = [], encoder._ids
    encoder._ids = lambda text: through.append(text) or rule(text)
    for tail in tails:
        for text in ("x " + " ".join(w + tail for w in words), "x\n" + "\n".join(w + tail for w in words)):
            want = byte_bpe.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want
    assert not [t for t in through if t.endswith("&&&") and t != "&&&"]
