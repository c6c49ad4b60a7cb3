"""Best-fit packing planned on a histogram of lengths.

Only the counts of the lengths 1 to the capacity reach the driver. It runs
best fit, longest first, on counts: all pieces of one length that go to bins
with equal room are one run. Pieces then take the planned places by their rank
within their length. Ranks are counted in buckets, so that a length which a
third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseforge.llm import tables, tokens

CAPACITY = 2048
END_ID = 0
# Pieces ranked in one group, about; lengths with more have several.
BUCKET_PIECES = 2_000

RUNS_SCHEMA = (
    "length bigint, rank_from bigint, rank_to bigint, per_bin bigint, first_sequence bigint,"
    " first_offset bigint"
)


def plan_runs(histogram: dict[int, int], capacity: int) -> list[tuple]:
    """Runs ``(length, rank_from, rank_to, per_bin, first_sequence, first_offset)``.

    Pieces of a length with ranks from ``rank_from`` to ``rank_to`` (exclusive)
    go ``per_bin`` each, one after another from ``first_offset``, into the
    sequences from ``first_sequence``. Every step ends a length or uses up a
    group of bins, so the plan depends on the capacity and not on the counts.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, bins)
    rooms: list[int] = []
    runs, sequences = [], 0

    def put(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((first, bins))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, first = capacity, sequences
                bins = -(-left // (capacity // length))
                sequences += bins
            fit = room // length
            full = min(bins, left // fit)
            if full:
                runs.append((length, rank, rank + full * fit, fit, first, capacity - room))
                put(room - fit * length, first, full)
                rank, left = rank + full * fit, left - full * fit
                first, bins = first + full, bins - full
            if bins and left and left < fit:
                runs.append((length, rank, rank + left, left, first, capacity - room))
                put(room - left * length, first, 1)
                rank, left = rank + left, 0
                first, bins = first + 1, bins - 1
            put(room, first, bins)
    return runs




def cut_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """``docs (doc_id, text)`` encoded, ended with ``end_id`` and cut into pieces.

    A document of more than ``capacity`` ids is cut so that only its first piece
    is shorter. Returns ``doc_id, piece, start, length, ids_crc32`` and, on
    demand, ``ids``.
    """

    def cut(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = tokens.id_encoder(tokenizer)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            rows, parts = [], []
            for doc_id, text in tokens.rows_of(batch, "doc_id", "text"):
                raw = encoder.encode(text) + end
                n = len(raw) // 4
                start, stop, piece = 0, n % capacity or min(n, capacity), 0
                while start < n:
                    part = raw[4 * start : 4 * stop]
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(part)))
                    if with_ids:
                        parts.append(np.frombuffer(part, "<u4").astype("i8"))
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(parts, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.record_batch(arrays, names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (
        ", ids array<bigint>" if with_ids else ""
    )
    return docs.mapInArrow(cut, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) with sequence_id and offset.

    ``pieces`` is read several times and should be a stored table.
    """
    spark = pieces.sparkSession
    # At most `capacity` rows, whatever the input.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths outside 1 to {capacity}")
    runs = spark.createDataFrame(plan_runs(counts, capacity), RUNS_SCHEMA)
    # One row per length, like the counts.
    buckets = spark.createDataFrame(
        [(length, -(-n // BUCKET_PIECES)) for length, n in counts.items()], "length bigint, buckets bigint"
    )
    spread = pieces.join(F.broadcast(buckets), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))
    ).drop("buckets")
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = (
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = sizes.select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        spread.withColumn("own_rank", F.row_number().over(own) - 1)
        .join(bases, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("own_rank"))
        .drop("bucket", "base", "own_rank")
    )
    # The runs are bounded by the capacity: some thousand rows.
    taken = ranked.join(F.broadcast(runs), "length").where(
        (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    )
    nth = F.col("rank") - F.col("rank_from")
    return taken.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(nth / F.col("per_bin"))).alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("per_bin") * F.col("length")).alias("offset"),
    )


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of ``docs`` with their places in sequences of at most ``capacity`` ids.

    A null or empty text is its end id alone. Rows that repeat a document are
    packed each. An empty table gives no rows; further columns are left out.
    """
    plain = tables.documents(docs, id_col, text_col)
    pieces = tables.stored(cut_pieces(plain, tokenizer, capacity, end_id, with_ids), "pieces")
    return place(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, document_starts`` of pieces packed ``with_ids``.

    A group holds at most the capacity of a sequence.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten(F.col("parts.ids")).alias("ids"),
        F.col("parts.offset").alias("document_starts"),
    )
