"""Chat formatting that can be read back.

A turn is ``<|turn:ROLE|>TEXT<|end|>`` and a line end. Every rendered turn is
parsed again; where that does not give the source, or where its role or text
holds a control string of this or of common templates, it is rendered escaped
(``<|turn~:``): a mark goes inside each control string, and the mark itself is
doubled. The whole conversation is then parsed and compared once more. All of
it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseforge.llm import tables

OPEN, ESCAPED, CLOSE, END = "<|turn:", "<|turn~:", "|>", "<|end|>\n"
# Where a control string begins: <| |> <s> </s> [INST] [/INST]
_INSIDE = r"<(?=\||s>|/s>)|\|(?=>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "~", "~0"), f"({_INSIDE})", "$1~1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("")), F.lit("~0"), F.lit("~"))


def _rendered(role: Column, text: Column, begin: str) -> Column:
    return F.concat(F.lit(begin), role, F.lit(CLOSE), text, F.lit(END))


def segments(formatted: Column) -> Column:
    """The turns of a formatted text as they stand there, without their ends."""
    parts = F.split(formatted, r"\Q" + END + r"\E", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def _head(segment: Column) -> Column:
    return F.substring_index(segment, CLOSE, 1)


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted text.

    A segment ends at the first end mark, its head at the first closing mark.
    """

    def turn(segment: Column) -> Column:
        head = _head(segment)
        body = F.substring(segment, F.length(head) + len(CLOSE) + 1, F.length(segment))
        marked = head.startswith(ESCAPED)
        role = F.substring(
            head, F.when(marked, len(ESCAPED)).otherwise(len(OPEN)) + 1, F.length(head)
        )
        return F.struct(
            F.when(marked, unescape(role)).otherwise(role).alias("role"),
            F.when(marked, unescape(body)).otherwise(body).alias("text"),
        )

    return F.transform(segments(formatted), turn)


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", trained_role: str = "assistant",
) -> DataFrame:
    """``conv_id, formatted, loss`` of every conversation.

    ``loss`` lists the stretches to train on, the texts of ``trained_role``, in
    code points: ``turn`` (from 0), ``turn_start``, ``start``, ``end``. Null
    roles and texts are empty; turns that tie, or have no number (they come
    first), go by role, then text; repeated rows are turns of their own; rows
    without conv_id are one conversation. An empty table gives no rows; further
    columns are left out. A conversation is one text and so one row.
    """
    plain = tables.pick(turns, conv_col, turn_col, role_col, text_col)
    rows = plain.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    raw = _rendered(F.col("role"), F.col("text"), OPEN)
    masked = _rendered(escape(F.col("role")), escape(F.col("text")), ESCAPED)
    source = F.array(F.struct("role", "text"))
    conflict = F.concat("role", "text").rlike(_INSIDE) | (parse(F.col("raw")) != source)
    rendered = (
        rows.withColumn("raw", raw)
        .withColumn("one", F.when(conflict, masked).otherwise(F.col("raw")))
        .withColumn("head", F.length(_head(F.col("one"))) + len(CLOSE))
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rendered.withColumn("nth", (F.row_number().over(order) - 1).cast("int"))
        .withColumn("turn_end", F.sum(F.length("one")).over(so_far))
        .withColumn("turn_start", F.col("turn_end") - F.length("one"))
    )
    span = F.struct(
        F.col("nth").alias("turn"), "turn_start",
        (F.col("turn_start") + F.col("head")).alias("start"),
        (F.col("turn_end") - len(END)).alias("end"),
    )
    grouped = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", "one", "role", "text"))).alias("all"),
        F.array_sort(
            F.collect_list(F.when(F.col("role") == trained_role, span))
        ).alias("loss"),
    )
    same = parse(F.col("formatted")) == F.transform(
        "all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    )
    error = F.raise_error(F.concat(F.lit("cannot be read back: "), F.col("conv_id").cast("string")))
    return (
        grouped.withColumn("formatted", F.array_join("all.one", ""))
        .select("conv_id", F.when(same, F.col("formatted")).otherwise(error.cast("string")).alias("formatted"), "loss")
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of ``chats`` from ``formatted`` and ``loss`` alone."""
    there = chats.withColumn("segments", segments(F.col("formatted"))).withColumn(
        "turns", parse(F.col("formatted"))
    )

    def trained(span: Column) -> Column:
        segment = F.get("segments", span["turn"])
        text = F.substring(
            segment, (span["start"] - span["turn_start"] + 1).cast("int"),
            (span["end"] - span["start"]).cast("int"),
        )
        return F.when(segment.startswith(ESCAPED), unescape(text)).otherwise(text)

    listed = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return there.withColumn("trained", F.array_join(F.transform("loss", trained), "")).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
