"""The catalog's queries in plain SQL, one row per pair, for a second opinion."""

from __future__ import annotations

from clauseforge.plans.fixtures import (
    DOCUMENT_LANGUAGES,
    DOCUMENT_WORDS,
    LINE_NUMBERS,
    LINE_PERCENTS,
    LINE_STATUSES,
    LINE_YEARS,
    PART_RULE,
    PART_TYPES,
    PART_WORDS,
    WORD_WIDTH,
)

UNIT = 68719476736  # 2**36

PART_TESTS = (
    [f"p_type = '{t}'" for t in PART_TYPES]
    + [f"p_size % 5 = {r}" for r in range(5)]
    + [f"list_contains(string_split(p_name, ' '), '{w}')" for w in PART_WORDS]
)
DOCUMENT_TESTS = [f"lang = '{x}'" for x in DOCUMENT_LANGUAGES] + [
    f"list_contains(words, '{w}')" for w in DOCUMENT_WORDS
]

LINE_TESTS = (
    [f"l_linenumber = {x}" for x in LINE_NUMBERS]
    + [f"l_linestatus = '{x}'" for x in LINE_STATUSES]
    + [f"round(l_discount * 100) = {x}" for x in LINE_PERCENTS]
    + [f"year(l_shipdate) = {x}" for x in LINE_YEARS]
)


def _bits(tests: list[str]) -> str:
    return " + ".join(f"(CASE WHEN {t} THEN {1 << k} ELSE 0 END)::BIGINT" for k, t in enumerate(tests))


def _bit_text(tests: list[str]) -> str:
    return " || ".join(f"(CASE WHEN {t} THEN '1' ELSE '0' END)" for t in tests)


PART_ROWS = (
    f"SELECT p_partkey AS id, CASE WHEN {PART_RULE} THEN 1 ELSE 0 END AS label, "
    f"{_bits(PART_TESTS)} AS bits FROM part"
)
_DOCUMENTS = (
    "(SELECT d.doc_id, lang, quality, string_split_regex(translate(text, "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+') AS words "
    "FROM documents d JOIN labels USING (doc_id))"
)
JUDGED_ROWS = (
    f"SELECT doc_id AS id, quality AS label, {_bits(DOCUMENT_TESTS)} AS bits FROM {_DOCUMENTS}"
)
_ALL_DOCUMENTS = (
    "(SELECT doc_id, lang, string_split_regex(translate(text, "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+') AS words FROM documents)"
)
_DOCUMENT_RULE = (
    "(lang = 'de' AND list_contains(words, 'und')) OR "
    "(lang = 'en' AND list_contains(words, 'with') AND NOT list_contains(words, 'by'))"
)
DOCUMENT_ROWS = (
    f"SELECT doc_id AS id, CASE WHEN {_DOCUMENT_RULE} THEN 1 ELSE 0 END AS label, "
    f"{_bits(DOCUMENT_TESTS)} AS bits FROM {_ALL_DOCUMENTS}"
)


LINE_ROWS = f"SELECT (l_returnflag = 'R')::INTEGER AS label, {_bits(LINE_TESTS)} AS bits FROM lineitem"


def _consistent(rows: str) -> str:
    return (
        f"SELECT * FROM ({rows}) WHERE bits NOT IN "
        f"(SELECT bits FROM ({rows}) GROUP BY bits HAVING count(DISTINCT label) = 2)"
    )


def _distances(rows: str, where: str = "true") -> str:
    return f"""
WITH inst AS MATERIALIZED (SELECT * FROM ({rows}) WHERE {where})
SELECT bit_count(xor(p.bits, n.bits))::INTEGER AS d, CAST(count(*) AS VARCHAR) AS pairs
FROM inst p, inst n WHERE p.label = 1 AND n.label = 0 GROUP BY 1"""


def _pairs_cte(rows: str, where: str = "true") -> str:
    return f"""
inst AS MATERIALIZED (SELECT * FROM ({rows}) WHERE {where}),
pairs AS MATERIALIZED (
  SELECT p.bits AS pb, n.bits AS nb,
         CAST(round({UNIT}::DOUBLE / bit_count(xor(p.bits, n.bits))) AS HUGEINT) AS w
  FROM inst p, inst n WHERE p.label = 1 AND n.label = 0 AND p.bits <> n.bits)"""


def _told_apart(width: int, lit: str = "lit", p: str = "pb", n: str = "nb") -> str:
    """1 where literal ``lit`` tells the pair apart, else 0."""
    return (
        f"(CASE WHEN {lit} < {width} THEN (({p} & ~{n}) >> {lit}) & 1 "
        f"ELSE (({n} & ~{p}) >> ({lit} - {width})) & 1 END)"
    )


def _relevance(rows: str, width: int, where: str = "true", tail: str = "") -> str:
    return f"""
WITH {_pairs_cte(rows, where)},
lits AS (SELECT unnest(range(0, {2 * width}))::INTEGER AS lit),
rel AS (
  SELECT lit, coalesce(sum(w) FILTER (WHERE {_told_apart(width)} = 1), 0) AS r
  FROM lits LEFT JOIN pairs ON true GROUP BY lit)
SELECT lit, CAST(r AS VARCHAR) AS r FROM rel {tail}"""


def _counted_pairs(rows: str) -> str:
    """Pairs of distinct vectors with the number of row pairs behind each."""
    return f"""
inst AS MATERIALIZED (SELECT label, bits, count(*)::HUGEINT AS c FROM ({rows}) GROUP BY ALL),
pairs AS MATERIALIZED (
  SELECT p.bits AS pb, n.bits AS nb, p.c * n.c AS m, bit_count(xor(p.bits, n.bits))::INTEGER AS d
  FROM inst p, inst n WHERE p.label = 1 AND n.label = 0)"""


def _counted_relevance(rows: str, width: int) -> str:
    return f"""
WITH {_counted_pairs(rows)},
lits AS (SELECT unnest(range(0, {2 * width}))::INTEGER AS lit),
rel AS (
  SELECT lit, coalesce(sum(m * CAST(round({UNIT}::DOUBLE / d) AS HUGEINT))
    FILTER (WHERE {_told_apart(width)} = 1), 0) AS r
  FROM lits LEFT JOIN (SELECT * FROM pairs WHERE d > 0) ON true GROUP BY lit)
SELECT lit, CAST(r AS VARCHAR) AS r FROM rel"""


_SIZES = sum(1 << k for k in range(len(PART_TYPES), len(PART_TYPES) + 5))
_UNCERTAIN_ROWS = f"""
SELECT label, CASE WHEN p_size > 40 THEN bits & ~{_SIZES}::BIGINT ELSE bits END AS one,
       CASE WHEN p_size > 40 THEN {_SIZES}::BIGINT ELSE 0 END AS half
FROM ({PART_ROWS}) JOIN part ON id = p_partkey"""


def _uncertain_relevance(width: int, weighted: bool, where: str = "true") -> str:
    """Three-valued rows: ``one`` and ``half`` bit sets, more than 64 rows in all.

    A pair with certain differences shares one unit over those. With ``weighted``,
    a pair with uncertain differences only shares it over them instead.
    """
    rows = f"SELECT * FROM ({_UNCERTAIN_ROWS}) WHERE {where}"
    gap = "bit_count(to_one | to_zero)"
    if weighted:
        weight = f"CASE WHEN c > 0 THEN round({UNIT}::DOUBLE / c) ELSE 0 END"
        loose = f"CASE WHEN c = 0 AND m > 0 THEN round({UNIT // 2}::DOUBLE / m) ELSE 0 END"
    else:
        weight = f"CASE WHEN c + m1 > 0 THEN round({UNIT}::DOUBLE / (c + m1)) ELSE 0 END"
        loose = "0"
    return f"""
WITH inst AS MATERIALIZED ({rows}),
sets AS (
  SELECT p.one & ~n.one & ~n.half AS to_one, n.one & ~p.one & ~p.half AS to_zero,
         (p.one & n.half) | (p.half & ~n.one & ~n.half) AS to_one_half,
         (n.half & ~p.one & ~p.half) | (p.half & n.one) AS to_zero_half,
         p.half & n.half AS shared
  FROM inst p, inst n WHERE p.label = 1 AND n.label = 0),
pairs AS (
  SELECT *, {gap} AS c, bit_count(to_one_half | to_zero_half | shared) AS m,
         bit_count(to_one_half | to_zero_half) AS m1 FROM sets),
weights AS MATERIALIZED (
  SELECT to_one, to_zero, to_one_half, to_zero_half, shared,
         sum(CAST({weight} AS HUGEINT)) AS w, sum(CAST({loose} AS HUGEINT)) AS v
  FROM pairs GROUP BY ALL),
lits AS (SELECT unnest(range(0, {width}))::INTEGER AS k)
SELECT lit, CAST(r AS VARCHAR) AS r FROM (
  SELECT k AS lit, sum(((to_one >> k) & 1) * w + 2 * ((to_one_half >> k) & 1) * v + ((shared >> k) & 1) * v) AS r
  FROM lits, weights GROUP BY k
  UNION ALL
  SELECT k + {width}, sum(((to_zero >> k) & 1) * w + 2 * ((to_zero_half >> k) & 1) * v + ((shared >> k) & 1) * v)
  FROM lits, weights GROUP BY k)"""


def _coefficients(width: int) -> str:
    """Pairs by literal and by their certain and uncertain differences."""
    return f"""
WITH inst AS MATERIALIZED ({_UNCERTAIN_ROWS}),
sets AS (
  SELECT p.one & ~n.one & ~n.half AS to_one, n.one & ~p.one & ~p.half AS to_zero,
         (p.one & n.half) | (p.half & ~n.one & ~n.half) AS to_one_half,
         (n.half & ~p.one & ~p.half) | (p.half & n.one) AS to_zero_half,
         p.half & n.half AS shared
  FROM inst p, inst n WHERE p.label = 1 AND n.label = 0),
pairs AS MATERIALIZED (
  SELECT *, bit_count(to_one | to_zero) AS c, bit_count(to_one_half | to_zero_half | shared) AS m, count(*) AS w
  FROM sets GROUP BY ALL),
each AS (
  SELECT k AS lit, c, m, w, (to_one >> k) & 1 AS f, 2 * ((to_one_half >> k) & 1) + ((shared >> k) & 1) AS h
  FROM pairs, (SELECT unnest(range(0, {width}))::INTEGER AS k)
  UNION ALL
  SELECT k + {width}, c, m, w, (to_zero >> k) & 1, 2 * ((to_zero_half >> k) & 1) + ((shared >> k) & 1)
  FROM pairs, (SELECT unnest(range(0, {width}))::INTEGER AS k))
SELECT lit, c::INTEGER AS certain, m::INTEGER AS unsure, CAST(sum(w * f) AS VARCHAR) AS "full", CAST(sum(w * h) AS VARCHAR) AS part
FROM each WHERE f + h > 0 GROUP BY lit, c, m"""


def _uncertain_fit(width: int, select: str) -> str:
    """The whole training over three-valued rows, from the definition.

    With u = 0.5**(p+q), a pair of c certain and m uncertain differences is at
    distance c + m u; a literal on a certain one gains 1 and on an uncertain one u
    of it, half of that where both values are uncertain. While u can be told from
    0 in a double sum the relevance is that sum. For more rows the exact order is
    that of its limit for small u (``r``), then of the factor of u (``s``).
    """

    def meets(one: str, half: str, ones: str, zeros: str) -> str:
        return f"({one} & {ones}) = {ones} AND (({one} | {half}) & {zeros}) = 0"

    def gone(one: str, half: str, done: str) -> str:
        allows = f"(({one} | {half}) & t.o) = t.o AND ({one} & t.z) = 0"
        return f"len(list_filter({done}, lambda t: {allows})) > 0"

    def has(name: str) -> str:
        return (
            f"(CASE WHEN lits.lit < {width} THEN (to_one{name} >> lits.lit) & 1 "
            f"ELSE (to_zero{name} >> (lits.lit - {width})) & 1 END)"
        )

    bit = f"(1::BIGINT << (lit % {width}))"
    is_open = "p > 0 AND q > 0"
    both = f"((shared >> (lits.lit % {width})) & 1)"
    u = "power(0.5, n)"
    exact = (
        f"CASE WHEN c + m = 0 THEN 0 ELSE ({has('')} + {u} * {has('_half')} + {u} / 2 * {both}) / (c + m * {u}) END"
    )
    first = (
        f"CASE WHEN c > 0 THEN {has('')} * round({UNIT}::DOUBLE / c) WHEN m > 0 THEN "
        f"(2 * {has('_half')} + {both}) * round({UNIT // 2}::DOUBLE / m) ELSE 0 END"
    )
    second = (
        f"CASE WHEN c > 0 THEN (2 * {has('_half')} + {both}) * round({1 << 23}::DOUBLE / c) "
        f"- {has('')} * round(m * {1 << 24}::DOUBLE / (c * c)) ELSE 0 END"
    )
    return f"""
WITH RECURSIVE inst AS MATERIALIZED (
  SELECT label, one, half, count(*) AS w FROM ({_UNCERTAIN_ROWS}) GROUP BY ALL),
sets AS (
  SELECT p.one AS po, p.half AS ph, n.one AS no, n.half AS nh, p.w * n.w AS w,
         p.one & ~n.one & ~n.half AS to_one, n.one & ~p.one & ~p.half AS to_zero,
         (p.one & n.half) | (p.half & ~n.one & ~n.half) AS to_one_half,
         (n.half & ~p.one & ~p.half) | (p.half & n.one) AS to_zero_half, p.half & n.half AS shared
  FROM inst p, inst n WHERE p.label = 1 AND n.label = 0),
pairs AS MATERIALIZED (
  SELECT *, bit_count(to_one | to_zero) AS c, bit_count(to_one_half | to_zero_half | shared) AS m FROM sets),
lits AS MATERIALIZED (SELECT unnest(range(0, {2 * width}))::INTEGER AS lit),
fit AS (
  SELECT 0 AS term_no, 0 AS step, -1 AS lit, 0::BIGINT AS p, 0::BIGINT AS q,
         (SELECT sum(w)::BIGINT FROM inst) AS n, 0::BIGINT AS ones, 0::BIGINT AS zeros,
         []::STRUCT(o BIGINT, z BIGINT)[] AS done, 1 AS next_term, true AS more
  UNION ALL
  SELECT term_no, step, lit, p, q, CASE WHEN {is_open} THEN p + q ELSE rest + negatives END,
         CASE WHEN {is_open} THEN o ELSE 0 END, CASE WHEN {is_open} THEN z ELSE 0 END,
         CASE WHEN {is_open} THEN done ELSE list_append(done, {{'o': o, 'z': z}}) END,
         CASE WHEN {is_open} THEN term_no ELSE term_no + 1 END,
         ({is_open}) OR rest > 0
  FROM (
    SELECT any_value(term_no) AS term_no, any_value(step) AS step, any_value(lit) AS lit,
           any_value(o) AS o, any_value(z) AS z, any_value(done) AS done,
           coalesce(sum(w) FILTER (WHERE label = 1 AND NOT gone AND {meets('one', 'half', 'o', 'z')}), 0)::BIGINT AS p,
           coalesce(sum(w) FILTER (WHERE label = 0 AND {meets('one', 'half', 'o', 'z')}), 0)::BIGINT AS q,
           coalesce(sum(w) FILTER (WHERE label = 0), 0)::BIGINT AS negatives,
           coalesce(sum(w) FILTER (WHERE label = 1 AND NOT gone AND NOT allowed), 0)::BIGINT AS rest
    FROM (
      SELECT c.*, i.label, i.one, i.half, i.w, {gone('i.one', 'i.half', 'c.done')} AS gone,
             ((i.one | i.half) & c.o) = c.o AND (i.one & c.z) = 0 AS allowed
      FROM (
        SELECT *, CASE WHEN lit < {width} THEN ones | {bit} ELSE ones END AS o,
                  CASE WHEN lit < {width} THEN zeros ELSE zeros | {bit} END AS z
        FROM (
          SELECT lits.lit, any_value(next_term) AS term_no, any_value(step) + 1 AS step,
                 any_value(ones) AS ones, any_value(zeros) AS zeros, any_value(done) AS done,
                 round(CASE WHEN any_value(n) <= 64 THEN {1 << 40}::DOUBLE * sum(w * ({exact}))
                   ELSE sum(CAST(w * ({first}) AS HUGEINT)) END)::HUGEINT AS r,
                 CASE WHEN any_value(n) <= 64 THEN 0 ELSE sum(CAST(w * ({second}) AS HUGEINT)) END AS s
          FROM (
            SELECT s.step, s.ones, s.zeros, s.done, s.next_term, s.n, pairs.*
            FROM fit s JOIN pairs
              ON {meets('po', 'ph', 's.ones', 's.zeros')} AND {meets('no', 'nh', 's.ones', 's.zeros')}
             AND NOT ({gone('po', 'ph', 's.done')})
            WHERE s.more
          ), lits
          GROUP BY lits.lit
        ) ORDER BY r DESC, s DESC, lit LIMIT 1
      ) c, inst i
    ) HAVING count(*) > 0
  )
)
{select}"""


def _fit(rows: str, width: int, select: str) -> str:
    """The whole training as a recursive query, one row per chosen literal.

    ``ones``/``zeros`` is the partial term after the row and ``done`` the list of
    terms finished by then; ``more`` tells whether another literal follows.
    """

    def meets(bits: str, ones: str, zeros: str) -> str:
        return f"({bits} & {ones}) = {ones} AND ({bits} & {zeros}) = 0"

    def gone(bits: str, done: str) -> str:
        return f"len(list_filter({done}, lambda t: {meets(bits, 't.o', 't.z')})) > 0"

    bit = f"(1::BIGINT << (lit % {width}))"
    is_open = "p > 0 AND q > 0"
    return f"""
WITH RECURSIVE {_pairs_cte(rows)},
lits AS MATERIALIZED (SELECT unnest(range(0, {2 * width}))::INTEGER AS lit),
fit AS (
  SELECT 0 AS term_no, 0 AS step, -1 AS lit, 0::HUGEINT AS r, 0::BIGINT AS p, 0::BIGINT AS q,
         0::BIGINT AS ones, 0::BIGINT AS zeros, []::STRUCT(o BIGINT, z BIGINT)[] AS done,
         1 AS next_term, true AS more
  UNION ALL
  SELECT term_no, step, lit, r, p, q,
         CASE WHEN {is_open} THEN o ELSE 0 END,
         CASE WHEN {is_open} THEN z ELSE 0 END,
         CASE WHEN {is_open} THEN done ELSE list_append(done, {{'o': o, 'z': z}}) END,
         CASE WHEN {is_open} THEN term_no ELSE term_no + 1 END,
         ({is_open}) OR alive > p
  FROM (
    SELECT any_value(term_no) AS term_no, any_value(step) AS step, any_value(lit) AS lit,
           any_value(r) AS r, any_value(o) AS o, any_value(z) AS z, any_value(done) AS done,
           count(*) FILTER (WHERE label = 1 AND NOT gone AND {meets('bits', 'o', 'z')}) AS p,
           count(*) FILTER (WHERE label = 0 AND {meets('bits', 'o', 'z')}) AS q,
           count(*) FILTER (WHERE label = 1 AND NOT gone) AS alive
    FROM (
      SELECT c.*, i.label, i.bits, {gone('i.bits', 'c.done')} AS gone
      FROM (
        SELECT *, CASE WHEN lit < {width} THEN ones | {bit} ELSE ones END AS o,
                  CASE WHEN lit < {width} THEN zeros ELSE zeros | {bit} END AS z
        FROM (
          SELECT lits.lit, any_value(next_term) AS term_no, any_value(step) + 1 AS step,
                 any_value(ones) AS ones, any_value(zeros) AS zeros, any_value(done) AS done,
                 coalesce(sum(w) FILTER (WHERE {_told_apart(width, 'lits.lit')} = 1), 0)::HUGEINT AS r
          FROM (
            SELECT s.step, s.ones, s.zeros, s.done, s.next_term, pb, nb, w
            FROM fit s JOIN pairs
              ON {meets('pb', 's.ones', 's.zeros')} AND {meets('nb', 's.ones', 's.zeros')}
             AND NOT ({gone('pb', 's.done')})
            WHERE s.more
          ), lits
          GROUP BY lits.lit
        ) ORDER BY r DESC, lit LIMIT 1
      ) c, inst i
    ) HAVING count(*) > 0
  )
)
{select}"""


def _literals(bits: str, want: int, width: int) -> str:
    return (
        f"SELECT term_no, k AS feature, {want} AS want FROM "
        f"(SELECT row_number() OVER () AS term_no, t FROM (SELECT unnest(done) AS t FROM fit "
        f"WHERE NOT more)) f, (SELECT unnest(range(0, {width}))::INTEGER AS k) "
        f"WHERE ((t.{bits} >> k) & 1) = 1"
    )


def _terms(width: int) -> str:
    both = f"{_literals('o', 1, width)} UNION ALL {_literals('z', 0, width)}"
    return f"SELECT term_no::INTEGER AS term_no, feature, want FROM ({both})"


def _term_texts(width: int) -> str:
    literal = "'x' || (feature + 1) || CASE WHEN want = 0 THEN '^' ELSE '' END"
    return (
        f"SELECT term_no, string_agg({literal}, '' ORDER BY feature) AS term_text "
        f"FROM ({_terms(width)}) GROUP BY term_no"
    )


PART_WIDTH = len(PART_TESTS)
DOCUMENT_WIDTH = len(DOCUMENT_TESTS)
PROMO = "p_type = 'PROMO'"
PART_LABEL = f"CASE WHEN {PART_RULE} THEN 1 ELSE 0 END"

_PART_RELEVANCE = _relevance(PART_ROWS, PART_WIDTH)
_PART_TERMS = _fit(PART_ROWS, PART_WIDTH, _terms(PART_WIDTH))
_TRACE = (
    "SELECT step, lit, CAST(r AS VARCHAR) AS r, p, q FROM fit WHERE step > 0 AND term_no = 1"
)
_CLASSES = f"SELECT p_partkey AS id, CASE WHEN {PART_RULE} THEN 1.0 ELSE 0.0 END::DOUBLE AS class FROM part"
_CHARACTERS = (
    "(SELECT unnest(chars) AS c, generate_subscripts(chars, 1) - 1 AS position "
    "FROM (SELECT string_split(text, '') AS chars FROM documents))"
)

_JUDGED = (
    f"(SELECT (({PART_LABEL}) + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) % 2 AS label, "
    "CASE WHEN p_type = 'ECONOMY' OR (p_type = 'PROMO' AND p_size % 5 <> 1) THEN 1.0 ELSE 0.0 END::DOUBLE "
    "AS class FROM part)"
)
_MANY = """
WITH terms AS MATERIALIZED (
  SELECT (1 << t) + (1 << (6 + r)) + (1 << (11 + w)) + (1 << (11 + v)) AS wanted
  FROM range(6) AS a(t), range(5) AS b(r), range(16) AS c(w), range(16) AS d(v)
  WHERE w < v AND (t + 2 * r + w + 3 * v) % 3 <> 0)"""

_SHAPES = """
SELECT DISTINCT doc_id AS id, (ord(w[1]) - 97) * 78 + (ord(w[2]) - 97) * 3 + least(len(w), 4) - 2 AS feature
FROM (SELECT doc_id, unnest(list_distinct(words)) AS w FROM {source}) WHERE len(w) >= 2"""
_WORD_PAIRS = f"""
WITH labels_of AS MATERIALIZED (SELECT id, label FROM ({DOCUMENT_ROWS})),
shapes AS MATERIALIZED ({_SHAPES.format(source=_ALL_DOCUMENTS)}),
sizes AS MATERIALIZED (
  SELECT l.id, l.label, count(feature) AS size FROM labels_of l LEFT JOIN shapes USING (id) GROUP BY ALL),
common AS MATERIALIZED (
  SELECT p.id AS p, n.id AS n, count(*) AS shared FROM shapes p JOIN shapes n ON p.feature = n.feature
  JOIN labels_of lp ON lp.id = p.id AND lp.label = 1 JOIN labels_of ln ON ln.id = n.id AND ln.label = 0
  GROUP BY ALL),
pairs AS MATERIALIZED (
  SELECT a.id AS p, b.id AS n, (a.size + b.size - 2 * coalesce(shared, 0))::INTEGER AS d
  FROM sizes a JOIN sizes b ON a.label = 1 AND b.label = 0 LEFT JOIN common ON p = a.id AND n = b.id)"""
_WORD_RELEVANCE = f"""
{_WORD_PAIRS},
weighed AS MATERIALIZED (
  SELECT p, n, CAST(round({UNIT}::DOUBLE / d) AS HUGEINT) AS w FROM pairs WHERE d > 0),
shared AS (
  SELECT s.feature AS lit, sum(w) AS r FROM weighed JOIN shapes s ON s.id = p JOIN shapes o ON o.id = n
  AND o.feature = s.feature GROUP BY ALL),
ones AS (
  SELECT feature AS lit, sum(w) AS r FROM (SELECT p, sum(w) AS w FROM weighed GROUP BY p) JOIN shapes ON id = p GROUP BY ALL),
zeros AS (
  SELECT feature AS lit, sum(w) AS r FROM (SELECT n, sum(w) AS w FROM weighed GROUP BY n) JOIN shapes ON id = n GROUP BY ALL),
lits AS (SELECT unnest(range({WORD_WIDTH})) AS lit)
SELECT (lit + shift)::INTEGER AS lit, CAST(coalesce(r, 0) - coalesce(b, 0) AS VARCHAR) AS r FROM (
  SELECT lit, 0 AS shift, ones.r AS r, shared.r AS b FROM lits LEFT JOIN ones USING (lit) LEFT JOIN shared USING (lit)
  UNION ALL
  SELECT lit, {WORD_WIDTH}, zeros.r, shared.r FROM lits LEFT JOIN zeros USING (lit) LEFT JOIN shared USING (lit))"""
_PART_DIGEST = f"sha256({_bit_text(PART_TESTS)})"

ORACLE = {
    "split_counts": f"SELECT label, count(*) AS rows FROM ({PART_ROWS}) GROUP BY label",
    "empty_sides": (
        f"SELECT rows, label, NOT EXISTS (SELECT 1 FROM ({PART_ROWS}) i WHERE i.label = s.label "
        "AND (rows = 'all' OR NOT ((bits >> 3) & 1 = 1 AND (bits >> 7) & 1 = 0 OR bits & 1 = 1))) AS empty "
        "FROM (VALUES ('all', 1), ('all', 0), ('uncovered', 1), ('uncovered', 0)) s(rows, label)"
    ),
    "literal_match": f"SELECT p_partkey AS id, {PART_LABEL} AS label FROM part WHERE {PROMO}",
    "literal_miss": f"SELECT p_partkey AS id, {PART_LABEL} AS label FROM part WHERE NOT ({PROMO})",
    "split_flags": (
        f"SELECT p_partkey AS id, {PART_LABEL} AS label, "
        "CASE WHEN p_size % 5 <> 1 THEN 1 ELSE 0 END AS kept FROM part"
    ),
    "uncovered_positives": (
        f"SELECT p_partkey AS id FROM part WHERE ({PART_RULE}) AND NOT ({PROMO} AND p_size % 5 <> 1)"
    ),
    "onehot_sum": (
        "SELECT position::INTEGER AS position, (instr('aetn', c) - 1)::INTEGER AS code, count(*) AS rows "
        f"FROM {_CHARACTERS} WHERE instr('aetn', c) > 0 GROUP BY ALL"
    ),
    "index_encode": (
        "SELECT position::INTEGER AS position, instr('aetn', c)::INTEGER AS code, count(*) AS rows "
        f"FROM {_CHARACTERS} GROUP BY ALL"
    ),
    "vector_roundtrip": (
        "SELECT p_partkey AS id, feature::INTEGER AS feature, "
        f"CASE WHEN (({_bits(PART_TESTS)}) >> feature) & 1 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS value "
        f"FROM part, (SELECT unnest(range(0, {PART_WIDTH})) AS feature)"
    ),
    "assembled_columns": (
        "SELECT p_partkey AS id, 0 AS feature, p_size::DOUBLE AS value FROM part "
        "UNION ALL SELECT p_partkey, 1, p_retailprice FROM part"
    ),
    "text_source": (
        "SELECT (lang = 'en')::INTEGER AS label, translate(text, chr(13) || chr(10), '  ') AS seq, "
        "count(*) AS rows FROM documents GROUP BY ALL"
    ),
    "pair_distance": _distances(PART_ROWS),
    "pair_distance_documents": _distances(DOCUMENT_ROWS),
    "pair_distance_uncertain": f"""
WITH inst AS MATERIALIZED ({_UNCERTAIN_ROWS})
SELECT bit_count(xor(p.one, n.one) | xor(p.half, n.half))::INTEGER AS d, CAST(count(*) AS VARCHAR) AS pairs
FROM inst p, inst n WHERE p.label = 1 AND n.label = 0 GROUP BY 1""",
    "pair_distance_lineitem": (
        f"WITH {_counted_pairs(LINE_ROWS)} SELECT d, CAST(sum(m) AS VARCHAR) AS pairs FROM pairs GROUP BY d"
    ),
    "pair_semi": _distances(PART_ROWS, "(bits >> 3) & 1 = 1"),
    "pair_semi_uncovered": _distances(
        PART_ROWS, "label = 0 OR NOT ((bits >> 3) & 1 = 1 AND (bits >> 7) & 1 = 0)"
    ),
    "pair_semi_histograms": _distances(PART_ROWS, "(bits >> 7) & 1 = 0"),
    "pair_semi_uncovered_histograms": _distances(
        PART_ROWS, "label = 0 OR NOT ((bits >> 3) & 1 = 1 AND (bits >> 7) & 1 = 0)"
    ),
    "relevance_vector": _PART_RELEVANCE,
    "relevance_broadcast_positive": _PART_RELEVANCE,
    "relevance_broadcast_negative": _PART_RELEVANCE,
    "relevance_grid": _PART_RELEVANCE,
    "relevance_documents": _relevance(DOCUMENT_ROWS, DOCUMENT_WIDTH),
    "relevance_documents_drop": _relevance(_consistent(JUDGED_ROWS), DOCUMENT_WIDTH),
    "relevance_lineitem": _counted_relevance(LINE_ROWS, len(LINE_TESTS)),
    "relevance_uncertain": _uncertain_relevance(PART_WIDTH, True),
    "relevance_uncertain_distance": _uncertain_relevance(PART_WIDTH, False),
    "top_literal": _relevance(PART_ROWS, PART_WIDTH, tail="ORDER BY rel.r DESC, lit LIMIT 1"),
    "survivor_counts": (
        f"SELECT count(*) FILTER (WHERE {PART_LABEL} = 1) AS p, "
        f"count(*) FILTER (WHERE {PART_LABEL} = 0) AS q FROM part WHERE {PROMO}"
    ),
    "relevance_update_uncertain": _uncertain_relevance(PART_WIDTH, False, "(one >> 3) & 1 = 1"),
    "relevance_update_weighted": _uncertain_relevance(PART_WIDTH, True, "((one | half) >> 7) & 1 = 0"),
    "relevance_coefficients": _coefficients(PART_WIDTH),
    "relevance_update": _relevance(PART_ROWS, PART_WIDTH, "(bits >> 3) & 1 = 1"),
    "first_term_trace": _fit(PART_ROWS, PART_WIDTH, _TRACE),
    "first_term_trace_documents": _fit(DOCUMENT_ROWS, DOCUMENT_WIDTH, _TRACE),
    "learned_terms": _PART_TERMS,
    "learned_terms_broadcast_negative": _PART_TERMS,
    "learned_terms_grid": _PART_TERMS,
    "learned_terms_documents": _fit(DOCUMENT_ROWS, DOCUMENT_WIDTH, _terms(DOCUMENT_WIDTH)),
    "learned_terms_uncertain": _uncertain_fit(PART_WIDTH, _terms(PART_WIDTH)),
    "fit_two_sets": _PART_TERMS,
    "train_job_partitions": _PART_TERMS,
    "formula_terms": _fit(PART_ROWS, PART_WIDTH, _term_texts(PART_WIDTH)),
    "model_metadata": _fit(
        PART_ROWS,
        PART_WIDTH,
        f"SELECT (SELECT string_agg(term_text, ' + ' ORDER BY term_no) FROM ({_term_texts(PART_WIDTH)})) "
        "AS formula, sum(label)::BIGINT AS training_pos, (count(*) - sum(label))::BIGINT AS training_neg, "
        f"{PART_WIDTH} AS width, (SELECT len(done)::INTEGER FROM fit WHERE NOT more) AS term_count FROM inst",
    ),
    "conflicting_vectors": (
        f"SELECT vector, count(*) AS rows FROM (SELECT {_bit_text(DOCUMENT_TESTS)} AS vector, quality "
        f"FROM {_DOCUMENTS}) GROUP BY vector HAVING count(DISTINCT quality) = 2"
    ),
    "classify": _CLASSES,
    "sequence_rules": (
        "SELECT o_orderkey AS id, CASE WHEN month(o_orderdate) IN (3, 12) THEN 1.0 ELSE 0.0 END::DOUBLE "
        "AS class FROM orders"
    ),
    "classify_reloaded": _CLASSES,
    "classify_many_terms": (
        f"{_MANY} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM terms WHERE bits & wanted = wanted) "
        f"THEN 1.0 ELSE 0.0 END::DOUBLE AS class FROM ({PART_ROWS})"
    ),
    "covered_rows": (
        f"SELECT p_partkey AS id, {_PART_DIGEST} AS row_key, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 2 END AS term_no "
        f"FROM part WHERE {PART_RULE}"
    ),
    "erased_rows": (
        f"SELECT p_partkey AS id, {_PART_DIGEST} AS row_key, CASE WHEN {PROMO} THEN 2 ELSE 1 END AS step "
        f"FROM part WHERE NOT ({PROMO}) OR p_size % 5 = 1"
    ),
    "pair_distance_words": (
        f"{_WORD_PAIRS} SELECT d, CAST(count(*) AS VARCHAR) AS pairs FROM pairs GROUP BY d"
    ),
    "relevance_words": _WORD_RELEVANCE,
    "classify_held_out": (
        f"SELECT p_partkey AS id, {PART_LABEL} AS label, ({PART_LABEL})::DOUBLE AS class FROM part "
        "WHERE p_partkey % 5 = 0"
    ),
    "classify_csv_model": _CLASSES,
    "saved_term_rows": _fit(
        PART_ROWS,
        PART_WIDTH,
        "SELECT feature, value, count(*) AS terms FROM (SELECT k AS feature, "
        "CASE WHEN (t.o >> k) & 1 = 1 THEN 1.0 WHEN (t.z >> k) & 1 = 1 THEN 2.0 ELSE 0.0 END::DOUBLE AS value "
        "FROM (SELECT unnest(done) AS t FROM fit WHERE NOT more), "
        f"(SELECT unnest(range(0, {PART_WIDTH}))::INTEGER AS k)) GROUP BY ALL",
    ),
    "confusion": f"SELECT label, class, count(*) AS rows FROM {_JUDGED} GROUP BY ALL",
    "accuracy": (
        "SELECT count(*) FILTER (WHERE label = class) AS hits, count(*) AS rows, "
        "floor(count(*) FILTER (WHERE label = class) / count(*) * 1000000)::BIGINT AS per_million "
        f"FROM {_JUDGED}"
    ),
    "stream_user_counts": "SELECT user_id::VARCHAR AS seq, count(*) AS rows FROM events GROUP BY 1",
    "stream_merged_counts": "SELECT user_id::VARCHAR AS seq, count(*) AS rows FROM events GROUP BY 1",
    "stream_complete_counts": "SELECT event_type AS seq, count(*) AS rows FROM events GROUP BY 1",
    "stream_counts": "SELECT event_type AS seq, count(*) AS rows FROM events GROUP BY 1",
    "stream_classify": _CLASSES,
}
