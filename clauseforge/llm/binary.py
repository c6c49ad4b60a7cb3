"""Token ids in patched frame-of-reference blocks.

A file is one row of a Parquet table that Spark writes and commits, so a task
that is run again leaves no half-written file. Its ``payload`` is

    magic ``PFR1``, documents n (u4), ids m (u8), blocks k (u4)
    document ids (n x i8), document ids that are null (n x u1), lengths (n x u8)
    block starts in bytes from the first block (k + 1 x u8)
    blocks of up to 1024 ids: minimum (u4), width (u1), ids (u2), exceptions (u2),
        ids less the minimum packed at that width, high bits first,
        exception places (u2 each), exception values less the minimum (u4 each)

All numbers are little-endian. The width of a block is what the chosen
percentile of its ids needs; ids that need more are exceptions.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseforge.llm import tables, tokens

MAGIC = b"PFR1"
BLOCK = 1024
PERCENTILE = 90
# Ids after which a file is closed; a longer document makes a larger file.
FILE_IDS = 1 << 18
END_ID = 0

FILES_SCHEMA = (
    "shard int, file int, n_docs int, n_ids bigint, payload binary"
)


def _bits(values):
    """Bits each value needs."""
    import numpy as np

    return np.ceil(np.log2(values.astype("f8") + 1)).astype("i8")


def pack_blocks(ids, percentile: int = PERCENTILE) -> tuple[list[bytes], list[int]]:
    """The packed blocks of an id array, and the byte length of each."""
    import numpy as np

    n = len(ids)
    k = -(-n // BLOCK)
    if not k:
        return [], []
    grid = np.full((k, BLOCK), ids[-1], dtype="<u4")
    grid.reshape(-1)[:n] = ids
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    place = min(BLOCK - 1, BLOCK * percentile // 100)
    width = _bits(np.partition(rest, place, axis=1)[:, place])
    over = rest >> width[:, None].astype("u8")
    out: list[bytes] = [b""] * k
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        some = rest[rows]
        size = 2 if w <= 16 else 4
        big = some.astype(f">u{size}").view("u1").reshape(len(rows), BLOCK, size)
        bits = np.unpackbits(big, axis=2)[:, :, 8 * size - int(w):]
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1)
        for r, row in enumerate(rows):
            count = min(BLOCK, n - int(row) * BLOCK)
            places = np.flatnonzero(over[row, :count])
            out[row] = b"".join(
                (
                    struct.pack("<IBHH", int(low[row]), int(w), count, len(places)),
                    packed[r, : (count * int(w) + 7) // 8].tobytes(),
                    places.astype("<u2").tobytes(),
                    some[r, places].astype("<u4").tobytes(),
                )
            )
    return out, [len(b) for b in out]


def unpack_block(payload: bytes, at: int):
    """The ids of the block that starts at byte ``at``."""
    import numpy as np

    low, width, count, exceptions = struct.unpack_from("<IBHH", payload, at)
    at += 9
    size = (count * width + 7) // 8
    whole = 2 if width <= 16 else 4
    first, shift = _places(width, whole)
    # Every value lies within `whole` bytes and the next one.
    raw = np.zeros(size + whole + 1, "u4" if whole == 2 else "u8")
    raw[:size] = np.frombuffer(payload, "u1", size, at)
    first = first[:count]
    ids = raw[first]
    for k in range(1, whole + 1):
        ids <<= 8
        ids |= raw[first + k]
    ids >>= shift[:count]
    ids &= (1 << width) - 1
    ids = ids.astype("<u4")
    at += size
    places = np.frombuffer(payload, "<u2", exceptions, at)
    ids[places] = np.frombuffer(payload, "<u4", exceptions, at + 2 * exceptions)
    return ids + np.uint32(low)


def unpack_blocks(payload: bytes, at):
    """The ids of the blocks that start at the given bytes, those of one width together."""
    import numpy as np

    # What a short last block lacks is read as zeros and cut off by the caller.
    raw = np.frombuffer(payload + bytes(4 * BLOCK + 5), "u1")
    heads = raw[at[:, None] + np.arange(9)]
    low, width = heads[:, :4].copy().view("<u4"), heads[:, 4]
    count, exceptions = (heads[:, i : i + 2].copy().view("<u2")[:, 0].astype("i8") for i in (5, 7))
    ids = np.empty((len(at), BLOCK), "<u4")
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        whole = 2 if w <= 16 else 4
        first, shift = _places(int(w), whole)
        size = (BLOCK * int(w) + 7) // 8 + whole
        some = raw[(at[rows] + 9)[:, None] + np.arange(size)].astype("u4" if whole == 2 else "u8")
        found = some[:, first]
        for k in range(1, whole + 1):
            found <<= 8
            found |= some[:, np.minimum(first + k, size - 1)]
        found >>= shift
        found &= (1 << int(w)) - 1
        ids[rows] = found
    after = at + 9 + (count * width + 7) // 8
    for row in np.flatnonzero(exceptions):
        start, n = int(after[row]), int(exceptions[row])
        places = np.frombuffer(payload, "<u2", n, start)
        ids[row, places] = np.frombuffer(payload, "<u4", n, start + 2 * n)
    ids += low
    return ids.reshape(-1)


@functools.cache
def _places(width: int, whole: int):
    """The first byte of every value of a block, and the bits after it in ``whole + 1`` bytes."""
    import numpy as np

    bits = np.arange(BLOCK) * width
    return bits >> 3, (8 * (whole + 1) - width - (bits & 7)).astype("u4" if whole == 2 else "u8")


def write_file(doc_ids: list[int | None], lengths: list[int], ids) -> bytes:
    import numpy as np

    blocks, sizes = pack_blocks(ids)
    starts = np.concatenate(([0], np.cumsum(sizes, dtype="<u8"))).astype("<u8")
    return b"".join(
        (
            MAGIC,
            struct.pack("<IQI", len(doc_ids), len(ids), len(blocks)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            np.array(lengths, "<u8").tobytes(),
            starts.tobytes(),
            *blocks,
        )
    )


def read_file(payload: bytes):
    """``(doc_ids, lengths, ids)`` of a file."""
    import numpy as np

    if payload[:4] != MAGIC:
        raise ValueError("not a token file")
    n, m, k = struct.unpack_from("<IQI", payload, 4)
    at = 20
    doc_ids = np.frombuffer(payload, "<i8", n, at).tolist()
    nulls = payload[at + 8 * n : at + 9 * n]
    lengths = np.frombuffer(payload, "<u8", n, at + 9 * n)
    starts = np.frombuffer(payload, "<u8", k + 1, at + 17 * n)
    first = at + 17 * n + 8 * (k + 1)
    ids = unpack_blocks(payload, first + starts[:-1].astype("i8"))[:m]
    return [None if z else d for d, z in zip(doc_ids, nulls)], lengths, ids


def read_ids(payload: bytes, start: int, length: int):
    """``length`` ids from place ``start`` of a file, unpacking only the blocks they touch."""
    import numpy as np

    n, m, k = struct.unpack_from("<IQI", payload, 4)
    if not 0 <= start <= start + length <= m:
        raise ValueError(f"ids {start} to {start + length} of {m}")
    if not length:
        return np.empty(0, "<u4")
    starts = np.frombuffer(payload, "<u8", k + 1, 20 + 17 * n)
    first = 20 + 17 * n + 8 * (k + 1)
    low, high = start // BLOCK, (start + length - 1) // BLOCK
    found = [unpack_block(payload, first + int(starts[b])) for b in range(low, high + 1)]
    return np.concatenate(found)[start - low * BLOCK :][:length]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Files of the ids of ``docs (doc_id, text)``, in ascending doc_id order.

    Each range of doc_ids is a shard; its files follow one another. Null ids
    come first; rows that repeat an id stand next to each other.
    """

    def write(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = tokens.id_encoder(tokenizer)
        end = struct.pack("<I", end_id)
        doc_ids, lengths, parts, pending, number = [], [], [], 0, 0

        def close():
            ids = np.frombuffer(b"".join(parts), "<u4")
            payload = write_file(doc_ids, lengths, ids)
            columns = ([shard], [number], [len(doc_ids)], [len(ids)], [payload])
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["shard", "file", "n_docs", "n_ids", "payload"],
            )

        for batch in batches:
            for doc_id, text in tokens.rows_of(batch, "doc_id", "text"):
                got = encoder.encode(text) + end
                doc_ids.append(doc_id)
                lengths.append(len(got) // 4)
                parts.append(got)
                pending += lengths[-1]
                if pending >= FILE_IDS:
                    yield close()
                    doc_ids, lengths, parts, pending, number = [], [], [], 0, number + 1
        if doc_ids:
            yield close()

    ordered = docs.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id")
    )
    return ordered.mapInArrow(write, FILES_SCHEMA)


def read_documents(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it; ``with_ids`` adds them
    as ``ids array<bigint>``.
    """
    # One row per file; the sums before each are small numbers over an ordered window.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(
        "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start")
    )
    within = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        files.select("shard", "file", "n_ids")
        .withColumn("file_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
        .join(shards, "shard")
        .select("shard", "file", (F.col("file_start") + F.col("shard_start")).alias("file_start"))
    )

    def read(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for shard, number, payload in tokens.rows_of(batch, "shard", "file", "payload"):
                doc_ids, lengths, ids = read_file(payload)
                ends = np.cumsum(lengths, dtype="i8")
                begins = ends - lengths.astype("i8")
                raw = memoryview(ids.tobytes())
                arrays = [
                    pa.array([shard] * len(doc_ids), pa.int32()),
                    pa.array([number] * len(doc_ids), pa.int32()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(begins, pa.int64()),
                    pa.array(lengths.astype("i8"), pa.int64()),
                    pa.array(
                        [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins, ends)], pa.int64()
                    ),
                ]
                names = ["shard", "file", "doc_id", "local_start", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64())))
                    names.append("ids")
                yield pa.record_batch(arrays, names=names)

    schema = (
        "shard int, file int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"
        + (", ids array<bigint>" if with_ids else "")
    )
    found = files.select("shard", "file", "payload").mapInArrow(read, schema)
    return found.join(starts, ["shard", "file"]).select(
        "doc_id",
        (F.col("file_start") + F.col("local_start")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def token_files(docs: DataFrame, tokenizer: str, id_col="doc_id", text_col="text") -> DataFrame:
    """Write the files of ``docs`` to the shared folder and open them.

    Null texts are empty, an empty text is its end id alone, an empty table has
    no files, further columns are not looked at, and every row of a repeated
    document is a document of its own.
    """
    plain = tables.documents(docs, id_col, text_col)
    return tables.stored(write_ids(plain, tokenizer), "token-files")
