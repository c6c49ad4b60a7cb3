import hashlib
import random
import re

import pytest
from pyspark import cloudpickle

from clauseforge.llm import chat, decontaminate, minhash, quality, sharding, tables, toxicity
from clauseforge.llm import shingles as hashes_of_words
from odd import by_row, empty_documents, odd_documents, odd_rows

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Quality rules


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered),
    )


QUALITY = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute_quality(doc_id, text):
    m = brute_measures(text)
    return (doc_id, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])


def test_quality(spark):
    got = by_row(quality.apply_policy(quality.ledger(odd_documents(spark))), *QUALITY)
    assert got == sorted((brute_quality(*r) for r in odd_rows()), key=repr)
    rng = random.Random(2)
    texts = [
        (i, "".join(rng.choice(["a", "b", "#", "|", " ", " ", "\n", "\t", "x y z v w", "É"]) for _ in range(rng.randrange(60))))
        for i in range(400)
    ]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = by_row(quality.apply_policy(quality.ledger(docs)), *QUALITY)
    assert got == sorted((brute_quality(*r) for r in texts), key=repr)
    assert quality.ledger(empty_documents(spark)).count() == 0


def test_policies_read_the_ledger(spark):
    book = quality.ledger(odd_documents(spark)).cache()
    one = quality.Policy("x", ("few_words",))
    kept = quality.apply_policy(book, one)
    assert kept.where("NOT kept AND n_words >= 10 AND NOT base_failed").count() == 0
    rows = {r.rule: r for r in quality.ablations(book).collect()}
    fails = [r.fail_bits for r in book.collect()]
    for rule, bit in quality.BITS.items():
        assert rows[rule].failed == sum(bool(f & bit) for f in fails)
        assert rows[rule].alone == sum(f == bit for f in fails)


def test_keep_good_keeps_columns(spark):
    docs = odd_documents(spark)
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    bad = sum(1 for r in quality.apply_policy(quality.ledger(docs)).collect() if not r.kept)
    assert out.count() == docs.count() - bad


# Near-duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


NEAR = ["doc_id", "n_shingles", "component_id", "kept"]


def near_texts():
    """Chains and groups at every similarity, and one long group of variants."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(3, 80))]
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text).upper() if rng.random() < 0.3 else "  ".join(text))
            if rng.random() < 0.5:
                base = text
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_equal_brute_force(spark):
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert by_row(minhash.near_duplicates(docs), *NEAR) == sorted(brute_components(rows), key=repr)


def test_near_duplicates_odd_rows(spark):
    got = minhash.near_duplicates(odd_documents(spark)).collect()
    assert len(got) == len(odd_rows())
    by_text = {r.doc_id: r for r in got if r.doc_id not in (None, 3, 4)}
    assert by_text[15].component_id == by_text[16].component_id == 15
    assert by_text[15].kept and not by_text[16].kept
    assert by_text[0].kept and by_text[0].n_shingles == 0 and by_text[1].kept
    assert minhash.near_duplicates(empty_documents(spark)).count() == 0
    out = minhash.one_of_each(odd_documents(spark))
    assert out.columns == odd_documents(spark).columns
    ids = [r[0] for r in out.collect()]
    assert ids.count(4) == 1 and ids.count(16) == 0 and ids.count(None) == 1 and ids.count(3) == 2


def brute_groups(rows):
    """Groups of rows with words, by place in ``rows``, whatever their ids."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for n, a in enumerate(sets):
        for j, b in enumerate(sets[:n]):
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = root[n], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    groups = {}
    for n, r in enumerate(root):
        if sets[n]:
            groups.setdefault(r, []).append(rows[n])
    return list(groups.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_null_and_repeated_ids_are_linked_like_others(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, None, i % 9]), t) for i, t in near_texts()[:120]]
    rows += [(None, "a b c d e f " * 12 + "x"), (None, "a b c d e f " * 12 + "x y"), (None, "lonely words here")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    groups = brute_groups(rows)
    low = lambda group: min((i for i, _ in group if i is not None), default=None)
    wanted = sorted(
        ((i, len(shingles(t)), low(g), i == low(g)) for g in groups for i, t in g), key=repr
    )
    wanted += [(i, 0, i, True) for i, t in rows if not shingles(t)]
    assert by_row(minhash.near_duplicates(docs), *NEAR) == sorted(wanted, key=repr)
    # One row of each group stays, one that has its smallest id.
    kept = [tuple(r) for r in minhash.one_of_each(docs).collect()]
    assert len(kept) == len(groups) + len({r for r in rows if not shingles(r[1])})
    for g in groups:
        assert any(r in kept and r[0] == low(g) for r in g)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (21, 21)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[n] for n in (2, 3, 9, 8, 7)} == {1} and got[21] == 20
    assert {got[101 + i] for i in range(40)} == {100}


# Decontamination


def hits(text, items, size=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    words, hit, names = cut(text), set(), set()
    for item_id, item in items:
        terms = cut(item)
        n = min(size, len(terms))
        windows = {tuple(terms[i : i + n]) for i in range(len(terms) - n + 1)} if n else ()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(str(item_id))
    listed = ",".join(sorted(names))
    return len(words), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)


CONTAMINATION = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "the", "Of", "x1", "É", "nine"] + [f"w{rng.randrange(40)}"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 25])))) for i in range(25)]
    items += [(98, None), (99, "..!"), (3, "another text of item three that is quite long and has many words in it"),
              (97, "tie tie tie")]
    rows = list(odd_rows())
    for i in range(100, 300):
        text = [word() for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            text[3:3] = (rng.choice(items)[1] or "").split()[rng.randrange(3) :]
        rows.append((i, ", ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_row(decontaminate.contamination(docs, bench), *CONTAMINATION)
    assert got == sorted(((i, *hits(t, items)) for i, t in rows), key=repr)
    left = decontaminate.without_contaminated(docs, bench)
    assert sorted(map(repr, (r[0] for r in left.collect()))) == sorted(
        repr(i) for i, t in rows if not hits(t, items)[4]
    )
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.contamination(empty_documents(spark), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "alpha x beta"), (2, "alpha " + "x " * 30 + "beta"), (3, "beta")], "doc_id bigint, text string"
    )
    bench = spark.createDataFrame([(7, "alpha beta")], "item_id bigint, text string")
    found = decontaminate.proximity(docs, bench, slop=2).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 7)]


# Chats


def test_chats_round_trip(spark):
    rng = random.Random(8)
    bits = ["<|", "|>", "<|end|>\n", "<|turn:user|>", "~", "~0", "~1", "<s>", "</s>", "[INST]", "[/INST]", "\n", "a", "é😀", "<", "|", ">"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", text(), None]), rng.choice([text(), None, ""])) for c in range(120) for t in range(rng.randrange(1, 7))]
    rows += [(None, None, "assistant", "no id"), (5, 0, "assistant", "tie"), (5, 0, "assistant", "tie")]
    turns = spark.createDataFrame(
        [(*r, "Z") for r in rows], "conv_id bigint, turn bigint, role string, text string, Text string"
    )
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    groups = {}
    for c, t, role, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", x or ""))
    assert set(got) == set(groups)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, own in groups.items():
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        trained = "".join(x for *_, role, x in own if role == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == sha("".join(f"{role}\n{x}\n" for *_, role, x in own))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(trained), sha(trained))
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chats_mask_control_strings(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "</s>[INST] ok"), (1, 1, "assistant", "plain ~1")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    (row,) = chat.format_chats(turns).collect()
    assert row.formatted == "<|turn~:user|><~1/s>[~1INST] ok<|end|>\n<|turn:assistant|>plain ~1<|end|>\n"
    (span,) = row.loss
    assert row.formatted[span.start : span.end] == "plain ~1"


# Shards


@pytest.mark.parametrize("limit", [1, 40, 500, 10**9])
def test_shards(spark, limit):
    rows = odd_rows() + [(1000 + i, "x" * (i % 50)) for i in range(400)] + [(7, "equal rows here")] * 90
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sharding.assign(docs, limit).collect()
    assert sorted(((r.doc_id, r.n_bytes) for r in got), key=repr) == sorted(
        ((i, len((t or "").encode())) for i, t in rows), key=repr
    )
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    names = sorted(shards)
    for name, own in shards.items():
        total = sum(r.n_bytes for r in own)
        assert all(r.shard_bytes == total for r in own)
        assert total <= limit or len(own) == 1 or all(r.n_bytes == 0 for r in own)
    for a, b in zip(names, names[1:]):
        assert not b.startswith(a) or a == b
    assert sharding.assign(empty_documents(spark), limit).count() == 0


@pytest.mark.parametrize("limit", [300, 10**9])
def test_shards_are_files(spark, tmp_path, limit):
    rows = odd_rows() + [(1000 + i, "x" * (i % 50)) for i in range(300)] + [(7, "equal rows here")] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, limit)
    back = sharding.open_shards(spark, path)
    assert by_row(back, "doc_id", "text") == sorted(((i, t or "") for i, t in rows), key=repr)
    names = ("doc_id", "n_bytes", "shard", "depth", "shard_bytes")
    got = by_row(sharding.read_shards(spark, path), *names)
    planned = by_row(sharding.assign(docs, limit), *names)
    # The splits of rows that are equal go by their places, which are others in another run.
    plain = lambda rows: [r for r in rows if "+" not in r[2]]
    assert plain(got) == plain(planned) and len(got) == len(planned)
    # One file a shard.
    assert all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "shards").glob("shard=*"))
    assert len(list((tmp_path / "shards").glob("shard=*"))) == len({r[2] for r in got})
    sharding.write_shards(empty_documents(spark), f"{path}-none", limit)
    assert sharding.read_shards(spark, f"{path}-none").count() == 0


# Toxicity


def toxic_rows(n=1500):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ba", "lo", "ri", "te", "um"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 40))]
        toxic = rng.random() < 0.15
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["zorkba", "zorklo", "grumf", "idiot", "zorkum"])
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(toxic)))
    truth = dict(labels)
    return docs, labels, truth


def test_toxicity(spark):
    import zlib

    docs, labels, truth = toxic_rows()
    out = toxicity.score_documents(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, toxic int"),
    ).collect()
    assert sorted(r.doc_id for r in out) == [i for i, _ in docs]
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and sum(r.held_out for r in out) == len(held)
    judged = [r for r in held if r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in judged)
    assert right >= 0.95 * len(judged)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out)


def test_toxicity_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    out = toxicity.score_documents(odd_documents(spark), none).collect()
    assert len(out) == len(odd_rows()) and all(r.score == 0 and r.predicted == 0 for r in out)
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)] + [(None, 1), (2, None)], "doc_id bigint, toxic int")
    assert len(toxicity.score_documents(odd_documents(spark), labels).collect()) == len(odd_rows())
    assert toxicity.score_documents(empty_documents(spark), labels).count() == 0


def test_few_labelled_rows_still_have_voters(spark):
    rows = [(i, "you are an idiot and a moron" if i % 3 == 0 else f"a calm text number {i}") for i in range(12)]
    labels = [(i, int(i % 3 == 0)) for i in range(12)]
    out = toxicity.score_documents(
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, toxic int"),
    ).collect()
    toxic = [r.score for r in out if r.doc_id % 3 == 0]
    other = [r.score for r in out if r.doc_id % 3]
    assert min(toxic) >= 0.5 > max(other)


def test_label_model_recovers_known_voters():
    import numpy as np

    rng = np.random.default_rng(3)
    rows, share, n = 400_000, 0.2, toxicity.N_VOTERS
    if_toxic, if_other = rng.uniform(0.4, 0.8, n), rng.uniform(0.02, 0.15, n)
    label = rng.random(rows) < share
    votes = rng.random((rows, n)) < np.where(label[:, None], if_toxic, if_other)
    # The last voter mostly repeats the one before it: a correlation that the label does not explain.
    copied = rng.random(rows) < 0.8
    votes[copied, n - 1] = votes[copied, n - 2]
    together = votes.T.astype("f8") @ votes
    found_toxic, found_other, weight = toxicity.label_model(together, rows, share)
    for i in range(n - 2):
        assert abs(found_toxic[i] - if_toxic[i]) < 0.05 and abs(found_other[i] - if_other[i]) < 0.03
    assert max(weight[-2:]) < min(weight[:-2])


def test_term_bound_follows_the_evidence(spark):
    rows = spark.createDataFrame([(2, 2), (3, 3), (30, 30), (7, 10), (70, 90), (700, 900)], "t bigint, n bigint")
    got = {(r.t, r.n): r.b for r in rows.select("t", "n", toxicity.purity_bound(rows.t, rows.n).alias("b")).collect()}
    assert got[2, 2] < toxicity.PURITY < got[3, 3] < got[30, 30]
    assert got[7, 10] < toxicity.PURITY and got[70, 90] < got[700, 900]


def test_a_worker_keeps_no_words_between_tasks():
    def hashes(batches):
        for batch in batches:
            hashes_of_words.window_hashes(hashes_of_words.words_of(batch))
            yield len(hashes_of_words._kept)

    # As it travels to a worker.
    task = cloudpickle.loads(cloudpickle.dumps(hashes_of_words.giving_back(hashes)))
    hashes_of_words._kept.clear()
    assert list(task(["a b c d e f", "f g"])) == [6, 7]
    assert not hashes_of_words._kept


def test_scans_of_words_hold_few_documents(spark):
    spark.conf.unset(tables.SCAN_ROWS)
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert decontaminate.word_table(docs, "doc_id", "text", "corpus-words").count() == 1
    assert int(spark.conf.get(tables.SCAN_ROWS)) <= 512
