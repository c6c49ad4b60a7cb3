import hashlib
import random
import re

from clauseforge.llm import pii
from odd import by_row, empty_documents, odd_documents, odd_rows

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NAMES = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    found = [
        (m.start(), place, m.end(), kind)
        for place, (kind, pattern) in enumerate(BASE.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m.group())
    ]
    found.sort()
    counts = [sum(f[3] == k for f in found) for k in BASE]
    text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return (*counts, hashlib.sha256(text.encode()).hexdigest())


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(11)
    bits = [
        "a", "b.c", "@", "@x", ".de", "-", "+", "+1", " ", "4111 1111 1111 1111", "4111111111111111",
        "1.2.3.4", "255", "256", ".", "(359)", "555-5478", "0", "9", "é", "😀", "%", "_", "12-34", "00",
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    texts += ["1" * 30_000, "a@b" + ".c" * 20_000, "a" * 100_000, "+" + "1 " * 20_000, "1-" * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    got = by_row(pii.personal_data(docs), *NAMES)
    assert got == sorted(((i, *brute(t)) for i, t in enumerate(texts)), key=repr)


def test_odd_rows(spark):
    got = by_row(pii.personal_data(odd_documents(spark)), *NAMES)
    assert got == sorted(((i, *brute(t)) for i, t in odd_rows()), key=repr)
    assert pii.personal_data(empty_documents(spark)).count() == 0


def secrets(n):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        word = "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
        code = "".join(rng.choice("0123456789abcdef") for _ in range(20))
        key = "AKIA" + "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(16))
        rows.append(
            [
                f"the {word} has password={code} and {word}",
                f"we saw {key} in the {word}",
                f"item {word}-{word}-{i % 10} is a plain name",
            ][i % 3]
        )
    return rows


def test_trees_find_secrets_and_leave_plain_names(spark):
    texts = secrets(600)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    for i, text in enumerate(texts):
        if i % 3 == 2:
            assert got[i] == ""
        else:
            m = re.search(r"AKIA\w+|(?<==)\w+", text) if i % 3 else re.search("(?<==)[0-9a-f]+", text)
            assert f"secret:{m.start()}:{m.end()}" in got[i].split(",")


def test_redaction(spark):
    texts = ["mail a.b@c.de now", None, "", "ip 1.2.3.4, card 4111111111111111.", "clean 12", "é a@b.co é"]
    docs = spark.createDataFrame(
        [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")],
        "doc_id bigint, text string, TEXT string",
    )
    out = pii.redact(docs)
    assert out.columns == docs.columns
    rows = sorted((r[0], r[1]) for r in out.collect() if r[1] is not None)
    assert rows == [
        (0, "mail [EMAIL] now"), (0, "mail [EMAIL] now"), (2, ""), (3, "ip [IP], card [CARD]."),
        (4, "clean 12"), (5, "é [EMAIL] é"),
    ]


def found_in(texts, spark):
    """Per text what its spans hold, as (kind, match)."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    cut = lambda text, s: (s[0], text[int(s[1]) : int(s[2])])
    return [
        [cut(text, s.split(":")) for s in rows[i].split(",") if s] for i, text in enumerate(texts)
    ]


def test_rare_kinds_keep_their_spans(spark):
    """One candidate of a kind among very many of another one."""
    texts = [" ".join(secrets(600)[i::20]) for i in range(20)] * 40
    texts += ["please write to jo.doe at example dot org soon"]
    assert found_in(texts, spark)[-1] == [("mail", "jo.doe at example dot org")]


def test_format_finds_what_no_keyword_marks(spark):
    rng = random.Random(8)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    digits, hexa = "0123456789", "0123456789abcdef"
    texts, wanted = [], []
    for i in range(400):
        code, plain = "a1" + some(hexa, 30), f"{some('klmnop', 6)}-{some('klmnop', 6)}-{i % 10}"
        number = f"{some(digits[1:], 3)}-{some(digits, 2)}-{some(digits, 4)}"
        day = f"20{some(digits, 2)}-{some('01', 2)}-{some('012', 2)}"
        before = ("token = ", "ssn ") if i % 2 else ("the item ", "by ")
        texts.append(f"as {before[0]}{code} of {plain} on {day}, and {before[1]}{number} too")
        wanted.append([("secret", code), ("number", number)])
    # Digits of a code may form a card number.
    found = [[s for s in f if s[0] != "card"] for f in found_in(texts, spark)]
    assert all(set(f) <= set(w) for f, w in zip(found, wanted))
    bare = found[::2]
    assert sum(("number" in dict(f)) for f in bare) == 200
    assert sum(("secret" in dict(f)) for f in bare) >= 180
    assert found[1::2] == wanted[1::2]


def test_context_tells_equal_formats_apart(spark):
    """Codes in quotes are sometimes marked by a keyword, those before a full stop never."""
    rng = random.Random(12)
    texts = []
    for i in range(800):
        code = "a1" + "".join(rng.choice("0123456789abcdef") for _ in range(30))
        texts.append(
            [f'use token "{code}" for it', f'use it as "{code}" for it'][i % 2]
            if i < 400 else f"it was built as {code}. So it is"
        )
    found = [len(f) for f in found_in(texts, spark)]
    assert sum(found[:400:2]) == 200
    assert sum(n > 0 for n in found[1:400:2]) >= 190
    assert sum(n > 0 for n in found[400:]) <= 8


def test_the_rule_holds_in_a_table_of_any_size(spark):
    code, key = "0123456789abcdef" * 2, "AKIA" + "Z9" * 8
    texts = [f'token = "{code}" and {key}', f"a {code} here"]
    wanted = [[("secret", code), ("secret", key)], [("secret", code)]]
    assert found_in(texts, spark) == wanted
    assert found_in(texts[:1], spark) == wanted[:1]


def test_overlapping_spans_are_merged(spark):
    card = next(str(n) for n in range(411111111110, 411111111120) if luhn(str(n)))
    texts = [f'token = "ab{card}ef0123456789abcdef01234567" x', "card 4111111111111111."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r[1] for r in sorted(pii.redact(docs).collect())] == ['token = "[SECRET]" x', "card [CARD]."]
