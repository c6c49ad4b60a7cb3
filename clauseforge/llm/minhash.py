"""Near-duplicates by circulant MinHash, confirmed on whole sets.

Texts with equal shingle sets are one class from the start, by a 128-bit digest of
the set, and classes, not documents, are the nodes that bands, pairs and components
join; ids come back last. So rows without an id, and ids with several texts, are
linked like all others. The 128 signature values of a class come from two permutations of the 32-bit numbers: the first
is applied once to the hashed shingles, the second to the result less k for
k = 0 to 127, which shifts it circularly. 32 bands of four values find the
candidates: a pair at similarity 0.75 shares none with a probability below
6 in a million.

Every bucket first tests its members against its smallest one only. Buckets
whose members are then still in several components test the pairs across
components, so that none is left out. Before such a pair becomes a row it is
screened: its sets' sizes, the two-bit agreement of its signatures, and, for sets
of up to 512 shingles, the bits in which hashed pictures of the sets differ. Each
such bit is a shingle that only one set has, so that screen loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.llm import tables
from clauseforge.llm.shingles import giving_back, window_hashes, words_of
from clauseforge.llm.tokens import rows_of

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
WINDOW = 5
PERCENT = 75
# Of the 128 two-bit values, a pair at 0.75 agrees in 104 on average with a
# deviation of 4.4; fewer than this many has a probability of about 1 in 10^8.
AGREEING = 79
# Bits of the picture of a set, and the largest set that has one.
PICTURE_BITS, PICTURE_SHINGLES = 1024, 512


def shingle_set(text: str):
    """Sorted distinct hashes of the five-word shingles of ``text``."""
    import numpy as np

    return np.unique(window_hashes(words_of(text, lower=True), WINDOW))


def signature(shingles):
    """The circulant MinHash values of a non-empty set."""
    import numpy as np

    x = (shingles ^ (shingles >> np.uint64(32))).astype("u4")
    # The first permutation.
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x21F0AAAD)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x735A2D97)
    x ^= x >> np.uint32(15)
    shifts = np.arange(COORDINATES, dtype="u4")[:, None]
    least = np.full(COORDINATES, 0xFFFFFFFF, "u4")
    for at in range(0, len(x), 512):
        # The second permutation, shifted by one place per coordinate.
        t = x[None, at : at + 512] - shifts
        t ^= t >> np.uint32(16)
        t *= np.uint32(0x7FEB352D)
        t ^= t >> np.uint32(15)
        t *= np.uint32(0x846CA68B)
        t ^= t >> np.uint32(16)
        np.minimum(least, t.min(axis=1), out=least)
    return least


def _band_keys(values):
    """One 64-bit key per band; ``values`` has a row of coordinates per document."""
    import numpy as np

    from clauseforge.llm.shingles import mix

    grouped = values.reshape(len(values), BANDS, ROWS).astype("u8")
    total = np.broadcast_to(np.arange(BANDS, dtype="u8"), grouped.shape[:2]).copy()
    for r in range(ROWS):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return total.view("i8")


def _short_codes(values):
    """Two bits of every coordinate as four 64-bit numbers: low bits, then high bits."""
    import numpy as np

    bits = np.concatenate([values & np.uint32(1), values >> np.uint32(1) & np.uint32(1)], axis=1)
    packed = np.packbits(bits.astype("u1"), axis=1)
    return np.ascontiguousarray(packed).view("<i8")


def _picture(shingles):
    """The set as bits by the hash of each shingle."""
    import numpy as np

    bits = np.zeros(PICTURE_BITS, "u1")
    bits[(shingles & np.uint64(PICTURE_BITS - 1)).astype("i8")] = 1
    return np.packbits(bits).view("<i8")


SKETCH_SCHEMA = (
    "doc_id bigint, text_hash bigint, n_shingles bigint, content binary, bands array<bigint>, codes array<bigint>, picture array<bigint>"
)


def sketch(docs: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: hash of the text, set size, digest of the set, band keys, short codes."""

    def build(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        def lists(rows, filled, width):
            offsets = np.concatenate(([0], np.cumsum(np.where(filled, width, 0)))).astype("i4")
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))

        for batch in batches:
            ids, sizes, digests, values, pictures = [], [], [], [], []
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                shingles = shingle_set(text)
                ids.append(doc_id)
                sizes.append(len(shingles))
                if len(shingles):
                    digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    values.append(signature(shingles))
                else:
                    digests.append(None)
                small = 0 < len(shingles) <= PICTURE_SHINGLES
                pictures.append(_picture(shingles) if small else None)
            grid = np.array(values, "u4").reshape(-1, COORDINATES)
            filled = np.array(sizes, "i8") > 0
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    batch.column("text_hash"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    lists(_band_keys(grid), filled, BANDS),
                    lists(_short_codes(grid), filled, 4),
                    pa.array(pictures, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "n_shingles", "content", "bands", "codes", "picture"],
            )

    hashed = docs.withColumn("text_hash", tables.text_hash(F.col("text")))
    return hashed.mapInArrow(giving_back(build), SKETCH_SCHEMA)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``node, shingles`` of ``docs (node, text)``."""

    def build(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(text) for text in batch.column("text").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype("i4")
            values = np.concatenate(sets) if sets else np.empty(0, "u8")
            yield pa.record_batch(
                [
                    batch.column("node"),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view("i8"))),
                ],
                names=["node", "shingles"],
            )

    return docs.select("node", "text").mapInArrow(giving_back(build), "node bigint, shingles array<bigint>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets reach the similarity."""

    def of(side: str) -> DataFrame:
        """The sets of that side's nodes; the others are left where they lie."""
        asked = pairs.select(F.col(side).alias("node")).distinct()
        return sets.join(asked, "node", "left_semi").select(
            F.col("node").alias(side), F.col("shingles").alias(f"set_{side}")
        )

    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b")
    return (
        both.select("a", "b", shared.alias("shared"), total.alias("total"))
        .where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared")))
        .select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for the undirected ``links (a, b)``; the root is the smallest node.

    Alternates two steps that hang every node on the smallest of its
    neighbours, first the larger ones, then the smaller ones, until all hang on
    a root directly. Minima are taken by aggregation, so a node with very many
    neighbours is never gathered in one place.
    """

    def hung(around: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = around.groupBy("u").agg(F.min("v").alias("low")).select(
            "u", F.least("u", "low").alias("low")
        )
        return around.join(least, "u"), least

    def step(edges: DataFrame) -> DataFrame:
        both = edges.union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        larger, _ = hung(both)
        edges = larger.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        smaller, least = hung(edges)
        return (
            smaller.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .union(least.select("u", F.col("low").alias("v")))
            .where("u <> v").distinct()
        )

    def flat(edges: DataFrame) -> bool:
        """Every node hangs on one other, which hangs on none."""
        above = edges.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(1))
        hanging = edges.groupBy("u").agg((F.count("*") - 1).alias("n"))
        twice = above.join(hanging.select("u"), "u", "left_semi")
        return twice.union(hanging.where("n > 0")).isEmpty()

    edges = tables.stored(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    while not flat(edges):
        edges = tables.stored(step(edges), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``band, rep, root`` of the buckets that hold several components."""
    placed = members.select("band", "rep").join(
        roots.select(F.col("node").alias("rep"), "root"), "rep", "left"
    ).select("band", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s"))
    return placed.join(mixed.where("r <> s").select("band"), "band", "left_semi")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` of one bucket and two components that may be similar."""
    two = members.select(*[F.col(c).alias(f"{c}_2") for c in members.columns])
    differing = F.lit(0)
    for i in range(2):
        low = F.col("codes")[i].bitwiseXOR(F.col("codes_2")[i])
        high = F.col("codes")[i + 2].bitwiseXOR(F.col("codes_2")[i + 2])
        differing = differing + F.bit_count(low.bitwiseOR(high))
    unlike = F.lit(0)
    for i in range(PICTURE_BITS // 64):
        unlike = unlike + F.bit_count(F.col("picture")[i].bitwiseXOR(F.col("picture_2")[i]))
    sizes = F.least("n_shingles", "n_shingles_2"), F.greatest("n_shingles", "n_shingles_2")
    # With S shingles in both sets and D in only one, the similarity is (S - D) / (S + D).
    total = F.col("n_shingles") + F.col("n_shingles_2")
    met = members.join(
        two,
        (F.col("band") == F.col("band_2")) & (F.col("rep") < F.col("rep_2"))
        & (F.col("root") != F.col("root_2"))
        & (100 * sizes[0] >= percent * sizes[1]) & (differing <= COORDINATES - AGREEING)
        & ((100 + percent) * F.coalesce(unlike, F.lit(0)) <= (100 - percent) * total),
    )
    return met.select(F.col("rep").alias("a"), F.col("rep_2").alias("b")).distinct()


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further links between their components."""

    def root_of(side: str) -> DataFrame:
        return roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))

    ends = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")
    )
    over = components(ends).select(F.col("node").alias("root"), F.col("root").alias("over"))
    moved = roots.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    fresh = over.select(F.col("root").alias("node"), F.col("over").alias("root"))
    return moved.union(fresh.join(roots.select("node"), "node", "left_anti"))


def _classes(
    docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component, component_id`` of every row of ``docs``.

    ``component`` is a number of the component, null for texts without words.
    """
    plain = tables.documents(docs, id_col, text_col)
    sketches = tables.stored(sketch(plain), "sketches")
    # Equal texts are one row per task before each shuffle.
    texts = (
        sketches.where(F.col("content").isNotNull())
        .groupBy("content", "text_hash")
        .agg(F.min("doc_id").alias("low"), F.max("n_shingles").alias("n_shingles"))
    )
    classes = texts.groupBy("content").agg(
        F.min("low").alias("low_id"), F.min("text_hash").alias("rep_hash"), F.max("n_shingles").alias("n_shingles")
    )
    # Numbered by their smallest id, as the earliest text of a bucket is often the one the others
    # are copies of; written with the numbers, so that they stay the same for all that follows.
    ordered = classes.orderBy(F.asc_nulls_last("low_id"), "content")
    classes = tables.stored(ordered.withColumn("rep", F.monotonically_increasing_id()), "classes")
    chosen = classes.select("rep", "content", F.col("rep_hash").alias("text_hash"))
    # One row of each class: the smallest id of one of its texts.
    chosen = texts.join(chosen, ["content", "text_hash"]).select(
        "rep", F.col("text_hash").alias("_hash"), F.col("low").alias("_low")
    )
    chosen = tables.stored(chosen, "representatives")
    its_row = (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_low"))
    reps = sketches.where(F.col("content").isNotNull()).join(chosen, its_row).select(
        "rep", "n_shingles", "bands", "codes", "picture"
    )
    # The bands of the representatives, one row per band.
    banded = reps.select("rep", F.explode("bands").alias("band")).distinct()
    buckets = banded.groupBy("band").agg(F.min("rep").alias("low"), F.count("*").alias("n"))
    shared = tables.stored(
        banded.join(buckets.where("n > 1"), "band").select("band", "rep", "low"), "buckets"
    )
    sizes = classes.select("rep", "n_shingles")
    involved = chosen.join(shared.select("rep").distinct(), "rep", "left_semi")
    hashed = plain.withColumn("text_hash", tables.text_hash(F.col("text")))
    sets = tables.stored(
        shingle_sets(
            hashed.join(involved, its_row).select(F.col("rep").alias("node"), "text")
        ).dropDuplicates(["node"]),
        "shingle-sets",
    )

    a = sizes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"))
    b = sizes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"))
    # The set sizes alone allow the similarity.
    first = tables.stored(
        shared.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
        .join(a, "a").join(b, "b")
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .select("a", "b"),
        "pairs",
    )
    roots = tables.stored(
        components(tables.stored(_confirm(first, sets, percent), "links")), "roots"
    )
    screens = reps.select("rep", "n_shingles", "codes", "picture").dropDuplicates(["rep"])
    members = tables.stored(
        _mixed(shared.select("band", "rep"), roots).join(screens, "rep"), "mixed-buckets"
    )
    open_pairs = tables.stored(
        _across(members, percent).join(first, ["a", "b"], "left_anti"), "open-pairs"
    )
    links = tables.stored(_confirm(open_pairs, sets, percent), "links")
    if not links.isEmpty():
        roots = tables.stored(_joined(roots, links), "roots")
    placed = classes.select("content", "rep", "low_id").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("content", "low_id", F.coalesce("root", "rep").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("low_id").alias("component_id"))
    rooted = placed.select("content", "component").join(lowest, "component")
    return sketches.select("doc_id", "text_hash", "n_shingles", "content").join(
        rooted, "content", "left"
    ).select(
        "doc_id", "text_hash", "n_shingles", "component",
        # Without words a row is linked with nothing.
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Texts without words are linked with nothing. Rows with a null id are linked as
    all others; a component without any id has a null component_id, and all of its
    rows count as kept, as their ids equal it. An id with several texts may be in
    several components. Repeated rows are each returned. An empty table gives no
    rows.
    """
    kept = F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept")
    return _classes(docs, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", kept)


def one_of_each(
    docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, columns as they were.

    The row with the smallest id stays, also where none of the group has an id; of
    several texts of that id the one with the smallest hash, and of equal rows one.
    Rows without words are in no group; equal ones of the same id are one row.
    """
    found = tables.stored(_classes(docs, percent, id_col, text_col), "classes-of-rows")
    lowest = F.col("component_id").eqNullSafe(F.col("doc_id"))
    first = found.where(lowest & F.col("component").isNotNull()).groupBy("component").agg(
        F.min("text_hash").alias("first_hash")
    )
    stays = lowest & (F.col("component").isNull() | (F.col("text_hash") == F.col("first_hash")))
    judged = tables.stored(
        found.join(first, "component", "left").select("doc_id", "text_hash", stays.alias("kept")), "kept-rows"
    )
    out = tables.without(
        docs, judged.where(~F.col("kept")).select("doc_id", "text_hash").distinct(), id_col, text_col
    )
    again = judged.where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    if again.where("n > 1").isEmpty():
        return out
    names = [f"_{i}" for i in range(len(docs.columns))]
    keys = [f"_{docs.columns.index(c)}" for c in (id_col, text_col)]
    return out.toDF(*names).dropDuplicates(keys).toDF(*docs.columns)
