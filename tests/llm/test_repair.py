import hashlib
import heapq
import random
import re
import zlib

import pytest

from clauseforge.llm import repair

NAMES = (
    "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
)
SOUND = re.compile(r"(?:s?(?:ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        named = ":".join(" " if x is None else str(x) for x in (conv, turn))
        way = zlib.crc32(named.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if way == 0:
            continue
        if way == 1:
            text = ""
        if way == 2:
            text = re.sub("[.!?]", "", text)
        if way == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if way == 3 else 1)
    return out


def cheapest(rows):
    """The cheapest edits by search over (cost, audit), one edit at a time."""
    after = {("B", "s"): "S", ("B", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    heap, done = [(0, "", 0, "B", ())], set()
    while heap:
        cost, audit, at, place, lines = heapq.heappop(heap)
        if (at, place) in done:
            continue
        done.add((at, place))
        if at == len(rows) and place in "BA":
            return cost, audit, lines

        def go(more, letter, nxt, role=None, text=""):
            line = () if role is None else (f"{role}:{text}",)
            to = place if role is None else after.get((place, role[:1]))
            if to:
                heapq.heappush(heap, (cost + more, audit + letter, nxt, to, lines + line))

        for role in ("user", "assistant"):
            go(5, "I", at, role)
        if at < len(rows):
            role, text, fault = rows[at]
            go(2, "D", at + 1)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                go(more, "K", at + 1, role, text)
                for new in ("user", "assistant"):
                    go(1 + more, "R", at + 1, new, text)


def brute(rows, ids):
    out = []
    for conv in ids:
        mine = [r[1:] for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in mine if t is not None]
        seen, checked = set(), []
        for _, role, text in mine:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = None
            if not last:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif last[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            checked.append((role, text, fault))
        cost, audit, lines = cheapest(checked)
        initials = "".join(line[0] for line in lines)
        assert SOUND.fullmatch(initials)
        found = [f for _, _, f in checked]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[found.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def check(spark, rows, harm=True, **options):
    df = table(spark, rows).repartition(3)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    wanted = brute(damage(rows) if harm else plain, {r[0] for r in rows})
    got = repair.repair(repair.damaged(df) if harm else df, df, **options)
    assert got.columns == list(NAMES)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def random_rows(rng, conversations, longest):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys"]
    texts = ["Yes.", "No", "ok!", "", " \n", "why?  ", None, "a b.\n", "é", "\x0b", "x\x85"]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(longest)):
            rows.append((
                conv if rng.random() < 0.97 else None, rng.choice([turn, turn, turn, turn + 3, None]),
                rng.choice(roles), rng.choice(texts),
            ))
    return rows


def test_whole_table_against_search(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_odd_rows(spark):
    rng = random.Random(4)
    check(spark, random_rows(rng, 150, 9))
    check(spark, random_rows(rng, 60, 12), harm=False)


def test_segments_change_nothing(spark):
    rng = random.Random(6)
    rows = random_rows(rng, 8, 60) + [(99, 7, "user", "The same.")] * 70
    for length in (1, 3, 16):
        check(spark, rows, harm=False, segment=length)


def test_dropped_conversation_and_clashing_columns(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = table(spark, [(gone, 0, "user", "Hello.")]).selectExpr("*", "'x' AS TEXT", "1 AS Conv_Id", "2 AS Turn")
    rows = repair.repair(repair.damaged(df), df).collect()
    assert [tuple(r) for r in rows] == [(gone, 0, 0, 0, 0, 0, 0, "", repair.NO_ROWS)]
    none = table(spark, [])
    assert repair.repair(repair.damaged(none), none).count() == 0


def test_any_split_gives_the_same_cells():
    rng = random.Random(1)
    for _ in range(200):
        rows = [repair.ROW_CELLS[rng.choice("sua?"), rng.randrange(4)] for _ in range(rng.randrange(2, 9))]
        whole = repair.combined(rows)
        for cut in range(1, len(rows)):
            assert repair.joined(repair.combined(rows[:cut]), repair.combined(rows[cut:])) == whole


@pytest.mark.parametrize(
    "initials, wanted",
    [("", (0, "")), ("u", (2, "D")), ("ua", (0, "KK")), ("sua", (0, "KKK")), ("uu", (1, "KR")), ("au", (2, "RR"))],
)
def test_small_cases(initials, wanted):
    cells = repair.combined([repair.ROW_CELLS[i, repair.FINE] for i in initials])
    assert min(cells[repair.B, q][:2] for q in repair.ENDS) == wanted
