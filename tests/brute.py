"""The definitions, written out pair by pair, to test against."""

from fractions import Fraction

UNIT = 2**36


def pair_weights(p, n, rows, halves="weighted"):
    """Per-literal relevance of one pair as exact fractions, with u = 0.5**rows."""
    width = len(p)
    u = Fraction(1, 2**rows)
    gain, distance = [Fraction(0)] * (2 * width), Fraction(0)
    for k, (a, b) in enumerate(zip(p, n)):
        if (a, b) == (1, 0):
            gain[k] += 1
            distance += 1
        elif (a, b) == (0, 1):
            gain[k + width] += 1
            distance += 1
        elif halves == "distance":
            distance += a != b
        elif (a, b) in ((1, 0.5), (0.5, 0)):
            gain[k] += u
            distance += u
        elif (a, b) in ((0, 0.5), (0.5, 1)):
            gain[k + width] += u
            distance += u
        elif (a, b) == (0.5, 0.5):
            gain[k] += u / 2
            gain[k + width] += u / 2
            distance += u
    return [g / (distance or 1) for g in gain]


def relevance(pos, neg, halves="weighted"):
    total = [Fraction(0)] * (2 * len(pos[0]))
    rows = len(pos) + len(neg)
    for p in pos:
        for n in neg:
            total = [t + w for t, w in zip(total, pair_weights(p, n, rows, halves))]
    return total


def units(pos, neg):
    """Whole-unit relevance of 0/1 rows."""
    width = len(pos[0])
    total = [0] * (2 * width)
    for p in pos:
        for n in neg:
            d = sum(a != b for a, b in zip(p, n))
            for k in range(width):
                if p[k] != n[k]:
                    total[k if p[k] else k + width] += round(Fraction(UNIT, d))
    return total


def learn(pos, neg):
    """Terms as {feature: want}; ``None`` where the data has no formula."""
    width, terms, left = len(pos[0]), [], list(pos)
    while left:
        term, p, n = {}, left, list(neg)
        while True:
            rel = relevance(p, n)
            lit = max(range(2 * width), key=lambda k: (rel[k], -k))
            feature, want = lit % width, int(lit < width)
            before, term[feature] = len(n), want
            p = [x for x in p if x[feature] == want]
            n = [x for x in n if x[feature] == want]
            if len(n) == before:
                return None
            if not p or not n:
                break
        rest = [x for x in left if any(x[k] == 1 - w for k, w in term.items())]
        if len(rest) == len(left):
            return None
        terms.append(term)
        left = rest
    return terms
