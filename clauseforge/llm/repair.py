"""Repair of conversation structure by weighted interval parsing.

A conversation is sound when its role initials read ``(s?(ua)+)?``. The repair
grammar is in Chomsky normal form. A nonterminal names the place in that pattern
before and after a span of rows: B (nothing yet), S (after s), U (after u), A
(after a). Its rules are

    [p q] -> [p r] [r q]      two neighbouring spans
    [p q] -> row              keep, rerole or delete, at a cost
    [p q] -> nothing          insertions that lead from p to q

and a span's chart cell for a nonterminal is the least (cost, audit) that any
derivation has. Insertions are closed over around every row, so a cell never
lacks a cheaper turn to insert. As nonterminals name both ends, every way of
splitting a span derives the same cells, and one split is enough: spans are
combined bottom-up, each level about twice as long as the one before. No audit of
a cell is the beginning of another of the same cost (both have one letter per row,
and insertions cost), so the least audit of a whole is made of least parts.

Rows are dealt out by range of (conv_id, turn), so a long conversation lies in
many tasks. Each turns runs of up to ``SEGMENT`` rows of a conversation into one
row with its chart cells. A conversation's segments are combined from their cells
alone. Then each segment is rendered where it lies, from the places in the
pattern at its ends; only the hash of a conversation, which cannot be split, reads
its rendered text in one task, streaming.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.llm import tables
from clauseforge.llm.tokens import rows_of

# Rows of a conversation that become one row with its cells.
SEGMENT = 256
# Copies of one row that are written out at a time.
COPIES = 1024
SPACE = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FINE, BLANK, DUPLICATE, CUT_OFF = 0, 1, 2, 3

# The pattern's places and what a role initial does to them.
B, S, U, A = range(4)
ENDS = (B, A)
NEXT = {(B, "s"): S, (B, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
REACHED = {B: (B, S, U, A), S: (S, U, A), U: (U, A), A: (U, A)}
# Per nonterminal its two-span rules, by the place in the middle.
RULES = [(p, q, [r for r in REACHED[p] if q in REACHED[r]]) for p in REACHED for q in REACHED[p]]
NO_ROWS = hashlib.sha256(b"").hexdigest()

_CELLS = "cells array<struct<p int, q int, cost bigint, audit string>>"
_NOTES = (
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint,"
    " first_turn bigint, last_turn bigint, first_role string, last_role string"
)


# The grammar


def joined(left: dict, right: dict) -> dict:
    """Cells of a span from those of its two parts; a cell is (cost, audit, places between parts)."""
    out = {}
    for p, q, middles in RULES:
        best = None
        for r in middles:
            a, b = left.get((p, r)), right.get((r, q))
            if a is None or b is None:
                continue
            cost = a[0] + b[0]
            if best is None or cost <= best[0]:
                found = (cost, a[1] + b[1], a[2] + b[2])
                if best is None or found < best:
                    best = found
        if best is not None:
            out[p, q] = best
    return out


def _insertions() -> dict:
    """The cells of a span without rows."""
    cells = {(p, p): (0, "", ()) for p in REACHED}
    one = dict(cells)
    for (p, role), q in NEXT.items():
        if role in "ua":
            one[p, q] = (INSERT, "I", ())
    return joined(one, one)


INSERTED = _insertions()


def row_cells(role: str, fault: int) -> dict:
    """The cells of one row, from its role initial and fault, closed under insertions."""
    cells = {(p, p): (DELETE, "D", ()) for p in REACHED}
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT_OFF else 0
        for (p, wanted), q in NEXT.items():
            edits = [(KEEP + more, "K", ())] if wanted == role else []
            if wanted in "ua":
                edits.append((REROLE + more, "R", ()))
            if edits:
                cells[p, q] = min(edits)
    return joined(joined(INSERTED, cells), INSERTED)


ROW_CELLS = {(role, fault): row_cells(role, fault) for role in "sua?" for fault in range(4)}


def combined(spans: list[dict]) -> dict:
    """The cells of neighbouring spans together, bottom-up by span length."""
    while len(spans) > 1:
        pairs = [joined(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + spans[len(spans) & ~1 :]
    return spans[0] if spans else INSERTED


def edited(audit: str, place: int, rows: list[tuple[str, str]]) -> list[str]:
    """The lines ``role:text`` that a segment's part of the audit leaves of its rows."""
    lines, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            place = NEXT[place, role[:1]]
        else:
            role = "assistant" if place == U else "user"
            place = A if place == U else U
        lines.append(f"{role}:{text}")
    return lines


# Rows


def plain_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with null roles and texts as one space."""
    tables.ship(turns.sparkSession)
    return tables.pick(turns, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
    )


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with a fifth of them damaged, by a checksum of conversation and turn."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    way = F.crc32(F.concat_ws(":", *named)) % 20
    rows = plain_turns(turns).withColumn("way", way).where("way != 0")
    text = (
        F.when(F.col("way") == 1, F.lit(""))
        .when(F.col("way") == 2, F.translate("text", "".join(ENDINGS), ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("way") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")


def faults(turns: DataFrame) -> DataFrame:
    """Every row with its first fault: ``conv_id, turn, role, text, digest, copy, fault``.

    Equal rows are counted before the shuffle and written out again after it, so
    a row that comes very often is one row per task.
    """
    exact = tables.stored(
        plain_turns(turns).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
        .withColumn("digest", F.sha2("text", 256)),
        "turns",
    )
    # Null turns come first.
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (
        exact.groupBy("conv_id", "role", "digest").agg(F.min(when).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    )
    seen = exact.join(
        again,
        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role"))
        & (F.col("digest") == F.col("_digest")),
        "left",
    )
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(bare == "", F.lit(BLANK))
        .when((F.col("copy") > 0) | (F.col("first") < when), F.lit(DUPLICATE))
        .when(~F.substring(bare, -1, 1).isin(*ENDINGS), F.lit(CUT_OFF))
        .otherwise(F.lit(FINE))
    )
    runs = seen.withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    places = F.expr(f"sequence(run * {COPIES}, least(copies, (run + 1) * {COPIES}) - 1)")
    return runs.withColumn("copy", F.explode(places)).select(
        "conv_id", "turn", "role", "text", "digest", "copy", fault.alias("fault")
    )


def segments(rows: DataFrame, length: int = SEGMENT) -> DataFrame:
    """Runs of up to ``length`` neighbouring rows of a conversation with their cells.

    ``conv_id, segment, roles, texts``, the cells, and what the rows hold. Segments of
    a conversation are in the order of ``segment``.
    """
    order = ["conv_id", "turn", "role", "digest", "copy"]
    ordered = (
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select(
            "conv_id", "turn", "role", "text", "fault",
            F.monotonically_increasing_id().alias("at"), F.substring("role", 1, 1).alias("initial"),
        )
    )

    def cut(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            kept = list(rows_of(batch, "conv_id", "turn", "initial", "fault"))
            starts = [0]
            for i in range(1, len(kept)):
                if kept[i][0] != kept[i - 1][0] or i - starts[-1] == length:
                    starts.append(i)
            ends = [*starts[1:], len(kept)]
            cells, notes = [], []
            for start, end in zip(starts, ends):
                found = combined(
                    [ROW_CELLS[r if r in ("s", "u", "a") else "?", f] for _, _, r, f in kept[start:end]]
                )
                cells.append([{"p": p, "q": q, "cost": c[0], "audit": c[1]} for (p, q), c in found.items()])
                notes.append(_notes(kept[start:end]))
            offsets = pa.array([*starts, len(kept)], pa.int32())
            names = [n.split()[0] for n in _NOTES.split(", ")]
            at = batch.column("at").to_pylist()
            columns = {
                "conv_id": pa.array([kept[s][0] for s in starts], pa.int64()),
                "segment": pa.array([at[s] for s in starts], pa.int64()),
                "roles": pa.ListArray.from_arrays(offsets, batch.column("role")),
                "texts": pa.ListArray.from_arrays(offsets, batch.column("text")),
                "cells": pa.array(cells, pa.list_(pa.struct(
                    [("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]
                ))),
            }
            columns |= {
                n: pa.array([x[i] for x in notes], pa.string() if n.endswith("role") else pa.int64())
                for i, n in enumerate(names)
            }
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return ordered.mapInArrow(
        cut, f"conv_id bigint, segment bigint, roles array<string>, texts array<string>, {_CELLS}, {_NOTES}"
    )


def _notes(rows: list[tuple]) -> tuple:
    """Numbers of faults, illegal neighbours and turns, and what the ends are."""
    found = [f for _, _, _, f in rows]
    roles = [r for _, _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    turns = [t for _, t, _, _ in rows if t is not None]
    return (
        found.count(BLANK), found.count(DUPLICATE), found.count(CUT_OFF), illegal, len(set(turns)),
        min(turns, default=None), max(turns, default=None), roles[0], roles[-1],
    )


def verdicts(cut: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``conv_id``, the counts, ``cost``, ``audit`` and each segment's part of the edits."""
    names = ["segment", "cells", *[n.split()[0] for n in _NOTES.split(", ")]]
    rows = cut.select("conv_id", F.struct(*names).alias("part"))
    if conversations is not None:
        ids = tables.pick(conversations, "conv_id").select(F.col("conv_id").cast("bigint").alias("conv_id"))
        rows = rows.unionByName(ids.distinct(), allowMissingColumns=True)
    # A conversation's slim parts, one for SEGMENT rows; without rows there is none.
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))

    def parse(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [judged(parts) for (parts,) in rows_of(batch, "parts")]
            names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
            columns = [batch.column("conv_id")]
            columns += [pa.array([r[n] for r in out], pa.int64()) for n in names]
            columns += [
                pa.array([r["audit"] for r in out], pa.string()),
                pa.array([r["edits"] for r in out], pa.list_(pa.struct(
                    [("segment", pa.int64()), ("place", pa.int32()), ("part", pa.string())]
                ))),
            ]
            yield pa.record_batch(columns, names=["conv_id", *names, "audit", "edits"])

    return whole.mapInArrow(
        parse,
        "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
        " cost bigint, audit string, edits array<struct<segment bigint, place int, part string>>",
    )


def judged(parts: list[dict]) -> dict:
    """One conversation from its segments in order."""
    out = {n: sum(p[n] for p in parts) for n in ("blank", "duplicate", "truncated", "illegal")}
    known = [p for p in parts if p["turns"]]
    out["illegal"] += sum(
        a["last_role"] + b["first_role"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:])
    )
    out["gaps"] = 0
    if known:
        # A turn that two neighbouring segments share counts once.
        shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:]))
        turns = sum(p["turns"] for p in known) - shared
        out["gaps"] = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - turns
    charts = [{(c["p"], c["q"]): c for c in p["cells"]} for p in parts]
    # A cell of one segment notes where it ends; the last of these is the whole's end.
    spans = [{(p, q): (c["cost"], c["audit"], (q,)) for (p, q), c in chart.items()} for chart in charts]
    whole = combined(spans)
    cost, audit, places = min(whole[B, q] for q in ENDS if (B, q) in whole)
    starts = (B, *places)
    out |= {"cost": cost, "audit": audit}
    out["edits"] = [
        {"segment": p["segment"], "place": a, "part": chart[a, b]["audit"]}
        for p, chart, a, b in zip(parts, charts, starts, places)
    ] if parts else []
    return out


def rendered(cut: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, segment, lines``: what each segment leaves, segments without lines not at all."""
    edits = found.select(F.explode("edits").alias("e")).select("e.*").withColumnRenamed("segment", "_segment")
    rows = cut.select("conv_id", "segment", "roles", "texts").join(edits, F.col("segment") == F.col("_segment"))

    def render(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [
                edited(part, place, list(zip(roles, texts)))
                for part, place, roles, texts in rows_of(batch, "part", "place", "roles", "texts")
            ]
            lines = pa.array(["\n".join(x) if x else None for x in out], pa.string())
            yield pa.record_batch(
                [batch.column("conv_id"), batch.column("segment"), lines], names=["conv_id", "segment", "lines"]
            )

    lines = rows.mapInArrow(render, "conv_id bigint, segment bigint, lines string")
    return lines.where("lines IS NOT NULL")


def hashed(lines: DataFrame) -> DataFrame:
    """``conv_id, sha``: SHA-256 of a conversation's lines, read segment by segment."""

    def run(batches) -> Iterator:
        import hashlib

        import pyarrow as pa

        conversation, state = None, None
        for batch in batches:
            ids, shas = [], []
            for conv_id, text in rows_of(batch, "conv_id", "lines"):
                if state is not None and conv_id == conversation:
                    state.update(b"\n")
                else:
                    if state is not None:
                        ids.append(conversation)
                        shas.append(state.hexdigest())
                    conversation, state = conv_id, hashlib.sha256()
                state.update(text.encode())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(shas, pa.string())], names=["conv_id", "sha"])
        if state is not None:
            yield pa.record_batch(
                [pa.array([conversation], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "sha"]
            )

    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, "conv_id bigint, sha string")


def repair(turns: DataFrame, conversations: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """The cheapest repair of every conversation of ``turns``, and of ``conversations`` without turns.

    Columns: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``. Rows are read by turn, nulls first; rows of the same turn by
    role and then by the SHA-256 of their text, equal rows next to each other, all
    but the first of them duplicates. A null role or text is one space, a null
    conv_id a conversation of its own. Conversations without rows have zeros, an
    empty audit and the hash of an empty string. Further columns are ignored; an
    empty table gives no rows.
    """
    cut = tables.stored(segments(faults(turns), segment), "segments")
    found = tables.stored(verdicts(cut, conversations), "verdicts")
    shas = hashed(rendered(cut, found)).withColumnRenamed("conv_id", "_conv")
    out = found.join(shas, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return out.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha", F.lit(NO_ROWS)).alias("repaired_sha256"),
    )
