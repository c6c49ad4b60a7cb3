"""DuckDB counterparts of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws
    FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS w
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM words)
), again AS (
    SELECT doc_id, i FROM windows
    QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again)
    GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
    WHERE regexp_matches(line, '{_WORDS}') GROUP BY doc_id
), measured AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0)::BIGINT AS n_lines,
        len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_letter_words,
        len(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_marks
    FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), ledger AS (
    SELECT *,
        (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
        + CASE WHEN n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
        + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 100 * n_letter_words < 60 * n_words THEN 64 ELSE 0 END
        + CASE WHEN 100 * n_marks > 50 * n_words THEN 128 ELSE 0 END)::BIGINT AS fail_bits
    FROM measured
)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM ledger
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORDS}') AS ws FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
        END AS s
    FROM words
), grams AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM sets
    UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), roots AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM sets JOIN roots USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all({_LOWERED}, '{_TERMS}') AS ws FROM documents
), items AS (
    SELECT item_id, regexp_extract_all({_LOWERED}, '{_TERMS}') AS ws FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, ws[i:i + 9] AS w
    FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM items WHERE len(ws) > 0)
), sizes AS (
    SELECT DISTINCT len(w) AS n FROM item_windows
), doc_windows AS (
    SELECT doc_id, i, ws[i:i + n - 1] AS w
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, sizes)
), hits AS (
    SELECT doc_id, i, len(w) AS n, item_id FROM doc_windows JOIN item_windows USING (w)
), words_hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits)
    GROUP BY doc_id
), names AS (
    SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS names FROM hits GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(len(names), 0)::BIGINT AS n_items,
    sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words_hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""

_CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")


def _controls(value: str) -> str:
    return " + ".join(
        f"(len({value}) - len(replace({value}, '{c}', ''))) // {len(c)}" for c in _CONTROLS
    )


CHATS = f"""
WITH source AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
        ({_controls("role")}) + ({_controls("text")}) AS marks
    FROM source
), sized AS (
    SELECT *, len(role) + len(text) + 17 + CASE WHEN marks = 0 THEN 0 ELSE
        1 + 2 * marks + (len(role) - len(replace(role, '~', ''))) + (len(text) - len(replace(text, '~', '')))
        END AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
    coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

SHARDS = f"""
WITH hashed AS (
    SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
    FROM documents
), deep AS (
    SELECT *, unnest(range(0, 61)) AS d FROM hashed
), prefixes AS (
    SELECT doc_id, n_bytes, d, h >> (60 - d)::INTEGER AS p FROM deep
), fits AS (
    SELECT d, p, sum(n_bytes)::BIGINT AS shard_bytes FROM prefixes GROUP BY d, p
    HAVING sum(n_bytes) <= 1048576 OR count(*) = 1
), found AS (
    SELECT doc_id, n_bytes, d, p, shard_bytes FROM prefixes JOIN fits USING (d, p)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1
)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), d::INTEGER, '0') END AS shard,
    d::INTEGER AS depth, shard_bytes
FROM found
"""


def _edit(place: str, cost: str, letter: str) -> str:
    """A (cost, audit) key, nine digits and the audit, after one more edit."""
    return f"lpad((left({place}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({place}, 10) || '{letter}'"


_TO_U = ", ".join(_edit(p, "5", "I") for p in "bsa")
_TO_A = ", ".join([_edit("u", "5", "I"), *[_edit(p, "10", "II") for p in "bs"]])


def _kept(place: str, role: str) -> str:
    return f"CASE WHEN must_go THEN NULL WHEN role[1] = '{role}' THEN {_edit(place, 'more', 'K')} END"


def _reroled(place: str) -> str:
    return f"CASE WHEN must_go THEN NULL ELSE {_edit(place, '1 + more', 'R')} END"


# Places of the role pattern as columns: b nothing yet, s, u, a; one step per row.
REPAIRS = rf"""
WITH RECURSIVE bits AS (
    SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i)
    UNION ALL
    SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations
), ways AS (
    SELECT named.*, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
        lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1]))) % 20 AS way
    FROM named, crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
        CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN way = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM ways WHERE way <> 0
), placed AS (
    SELECT conv_id, turn, role, text, regexp_replace(text, '[ 	-]+$', '') AS bare,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos
    FROM damaged
), checked AS (
    SELECT *, CASE WHEN bare = '' THEN 1
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
        WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS pair
    FROM placed
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
        count_if(fault = 1)::BIGINT AS blank, count_if(fault = 2)::BIGINT AS duplicate,
        count_if(fault = 3)::BIGINT AS truncated,
        count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(*) AS n
    FROM checked GROUP BY conv_id
), dp AS (
    SELECT conv_id, 0::BIGINT AS pos, '000000000' AS b, NULL::VARCHAR AS s, '000000005I' AS u, '000000010II' AS a
    FROM counted
    UNION ALL
    SELECT conv_id, pos, b, s, least(u, {_TO_U}), least(a, {_TO_A}, {_edit(f"least(u, {_TO_U})", "5", "I")})
    FROM (
        SELECT dp.conv_id, c.pos, {_edit("b", "2", "D")} AS b,
            least({_edit("s", "2", "D")}, {_kept("b", "s")}) AS s,
            least({_edit("u", "2", "D")}, {", ".join(f(p, *r) for p in "bsa" for f, r in ((_kept, "u"), (_reroled, "")))}) AS u,
            least({_edit("a", "2", "D")}, {_kept("u", "a")}, {_reroled("u")}) AS a
        FROM dp JOIN (
            SELECT conv_id, pos, role, fault IN (1, 2) AS must_go, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS more FROM checked
        ) AS c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.pos = dp.pos + 1
    )
), best AS (
    SELECT dp.conv_id, least(b, a) AS best FROM dp JOIN counted AS c
        ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.pos
), edits AS (
    SELECT conv_id, k, substr(best, 9 + k, 1) AS edit,
        len(replace(substr(best, 10, k), 'I', '')) AS pos, len(replace(substr(best, 10, k), 'D', '')) AS place
    FROM (SELECT conv_id, best, unnest(range(1, len(best) - 8)) AS k FROM best)
), lines AS (
    SELECT e.conv_id, k, edit, place, c.role, CASE WHEN edit = 'I' THEN '' ELSE c.text END AS text,
        coalesce(bool_or(place = 1 AND edit = 'K' AND c.role[1] = 's') OVER (PARTITION BY e.conv_id), false) AS led
    FROM edits AS e LEFT JOIN checked AS c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.pos = e.pos
    WHERE edit <> 'D'
), repaired AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role
        WHEN (place - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS whole
    FROM lines GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
    coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 9)::BIGINT, 0)::BIGINT AS cost,
    coalesce(substr(best, 10), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS i
LEFT JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN repaired AS r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""
