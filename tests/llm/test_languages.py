import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseforge.llm import languages
from clauseforge.llm.queries import QUERIES
from odd import empty_documents, odd_documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small_net():
    draw = np.random.default_rng(5)
    make = lambda letters: "".join(draw.choice(list(letters), 80)).encode()
    windows = [("aa", make("abcde ")) for _ in range(40)] + [("bb", make("vwxyz é")) for _ in range(40)]
    return languages.train(windows, steps=60)


def direct(net, raw):
    """Probabilities of one window by plain convolution."""
    vectors = net.bytes[np.frombuffer(raw.ljust(languages.WINDOW + 4, b"\0"), "u1")]
    pooled = []
    for width, w in zip(languages.WIDTHS, net.filters):
        spans = np.array([vectors[i : i + width].reshape(-1) for i in range(languages.WINDOW)])
        pooled.append(np.maximum((spans @ w).max(axis=0), 0))
    logits = np.concatenate(pooled) @ net.weight + net.bias
    e = np.exp(logits - logits.max())
    return e / e.sum()


def test_tables_equal_plain_convolution(small_net):
    looked_up = languages.pair_tables(small_net)
    for raw in (b"abc ade", b"x", b"", "zé vw".encode() * 30, bytes(range(1, 256))):
        rows, added = languages.windows_of(raw)
        assert added.sum() == max(1, len(raw)) and len(rows) == len(added)
        got = languages.probabilities(small_net, looked_up, rows)
        for row, p in zip(rows, got):
            assert p == pytest.approx(direct(small_net, row.tobytes()), abs=1e-5)


def test_every_filter_sees_every_place():
    raw = bytes(np.random.default_rng(2).integers(1, 256, 3000, dtype="u1"))
    for length in (0, 1, 3, 4, 252, 253, 256, 257, 506, 509, 510, 3000):
        rows, added = languages.windows_of(raw[:length])
        seen = {r.tobytes()[i : i + 4] for r in rows for i in range(len(r.tobytes()) - 3)}
        assert all(raw[i : i + 4] in seen for i in range(length - 3))
        assert added.sum() == max(1, length)


def test_gradients_against_differences(small_net):
    draw = np.random.default_rng(8)
    params = [p.astype("f8") for p in (small_net.bytes, *small_net.filters, small_net.weight, small_net.bias)]
    batch, label = draw.integers(1, 256, (6, languages.WINDOW)).astype("u1"), draw.integers(0, 2, 6)

    def loss():
        table, *filters, weight, bias = params
        total = 0
        for row, k in zip(batch, label):
            vectors, pooled = table[row], []
            for width, w in zip(languages.WIDTHS, filters):
                spans = np.array([vectors[i : i + width].reshape(-1) for i in range(len(row) - width + 1)])
                pooled.append(np.maximum((spans @ w).max(axis=0), 0))
            logits = np.concatenate(pooled) @ weight + bias
            total += np.log(np.exp(logits - logits.max()).sum()) + logits.max() - logits[k]
        return total / len(batch)

    for p, g in zip(params, languages._gradients(params, batch, label)):
        flat = np.argsort(-np.abs(g).ravel())[:4]
        for at in flat:
            place = np.unravel_index(at, p.shape)
            old, h = p[place], 1e-6
            p[place] = old + h
            more = loss()
            p[place] = old - h
            less = loss()
            p[place] = old
            assert (more - less) / (2 * h) == pytest.approx(g[place], rel=1e-3, abs=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op12_language_id"](spark, SF).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= got[r.doc_id].score <= 1
    held = [r for r in rows if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert len(held) > 150 and right >= 0.98 * len(held)


def lettered(text):
    return any(unicodedata.category(c).startswith("L") for c in text or "")


def test_odd_rows(spark):
    docs = odd_documents(spark).withColumn("lang", F.when(F.col("source") == "s0", None).otherwise(F.lit("xx")))
    learnt = spark.createDataFrame([(100 + i, "plain words here " * (i + 1), None, None, None, "yy") for i in range(9)], docs.schema)
    both = docs.union(learnt)
    got = languages.identify(both, steps=5).collect()
    texts = sorted((r[0], lettered(r[1])) for r in both.collect() if r[0] is not None)
    assert len(got) == both.count()
    assert sorted((r.doc_id, r.lang_pred != "und") for r in got if r.doc_id is not None) == texts
    assert {r.lang_pred for r in got} <= {"xx", "yy", "und"}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    one = languages.identify(docs, steps=2).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("xx", 1.0), ("und", 0.0)}
    unknown = languages.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)} and len(unknown) == docs.count()
    none = languages.identify(empty_documents(spark).withColumn("lang", F.lit("xx")))
    assert none.columns == ["doc_id", "held_out", "lang_pred", "score"] and none.count() == 0


def test_sample_is_bounded_even_and_learns_from_others_only(spark):
    rows = [(i, f"text number {i} " * 40, "big") for i in range(3000)]
    rows += [(5000 + i, "copied text " * 50, "big") for i in range(2000)]
    rows += [(9000 + i, f"rare words {i}", "small") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    windows = languages.training_windows(docs, sample=200)
    texts = {raw for _, raw in windows}
    assert windows == languages.training_windows(docs.repartition(3), sample=200)
    assert len(windows) < 2 * 200 * languages.CROPS
    small = {raw.decode() for lang, raw in windows if lang == "small"}
    held = {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert small == {t for i, t, lang in rows if lang == "small"} - {t for t in held if t.startswith("rare")}
    assert not any(raw.decode() in held for raw in texts if not raw.startswith(b"copied"))
