"""Whitening of embeddings with a covariance from polarisation.

Entries become whole numbers x = floor(256 c). With var(a + b) = var(a) + var(b)
+ 2 cov(a, b), the covariance of two dimensions follows from three variances, so
all that is aggregated is one sum of squares per dimension and per sum of two
dimensions. Values are centred before they are squared: by the whole part m of
the mean first, and the remaining fraction r / n exactly, as

    sum (n x - S)^2 = n^2 sum (x - m)^2 - n r^2   with S = n m + r.

Every aggregated number is a whole number, so the covariance does not depend on
how rows were partitioned and is rounded once, when it becomes a double.

Distinct vectors are counted before the shuffle, so a vector that a third of all
rows share is one row per task. The driver gets d (d + 1) / 2 numbers for d
dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseforge.llm import tables

SCALE = 256
COMPONENTS = 4
# Below this share of the total variance a component has none.
NO_VARIANCE = 1e-12
# Rows whose sums of squares are added up before they join the totals.
ROWS_AT_ONCE = 1024

RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double"
)


def lattice(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows whose vector has finite entries only."""
    tables.ship(embeddings.sparkSession)
    rows = tables.pick(embeddings, id_col, vector_col).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    )
    sound = (F.size("v") > 0) & F.forall("v", _finite)
    return rows.where(sound).select(
        "vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))).cast("bigint")).alias("x")
    )


def _finite(value: Column) -> Column:
    # Also null where the value is null, which ends as false.
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(value)


def _less(batch, middle: list[int]):
    """The vectors of a batch as rows of a matrix, less ``middle``.

    Entries over 2**25, whose sums of squares may pass 2**63, are Python's
    whole numbers.
    """
    import numpy as np

    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    x = flat.reshape(batch.num_rows, len(middle))
    least, most = (int(x.min()), int(x.max())) if x.size else (0, 0)
    if max(most - min(middle), max(middle) - least) >= 1 << 25:
        return x.astype(object) - np.array(middle, object)
    return x - np.array(middle, np.int64)


def pair_places(d: int) -> list[tuple[int, int]]:
    """The dimension pairs in the order of their sums; (i, i) stands for dimension i alone."""
    return [(i, j) for i in range(d) for j in range(i, d)]


def square_sums(z, rows_at_once: int = ROWS_AT_ONCE) -> list[int]:
    """Exact sums of squares of every column and of every sum of two columns, as pair_places."""
    import numpy as np

    d = z.shape[1]
    total = [0] * (d * (d + 1) // 2)
    for start in range(0, len(z), rows_at_once):
        part = z[start : start + rows_at_once]
        at = 0
        for i in range(d):
            both = part[:, i:] + part[:, i : i + 1]
            both[:, 0] = part[:, i]
            sums = (both * both).sum(axis=0)
            for k in range(d - i):
                total[at + k] += int(sums[k])
            at += d - i
    return total


def _totals(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the sum of every dimension."""
    places = fit.select(F.posexplode("x").alias("i", "value")).groupBy("i")
    got = places.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    return max((r["n"] for r in got), default=0), [int(r["s"]) for r in sorted(got, key=lambda r: r["i"])]


def centred_squares(fit: DataFrame, n: int, sums: list[int]) -> list[int]:
    """``sum (n y - sum y)^2`` over ``fit (x)`` for y a dimension or a sum of two, as pair_places."""
    d = len(sums)
    middle = [s // n for s in sums]

    def add(batches) -> Iterator:
        import pyarrow as pa

        total = [0] * (d * (d + 1) // 2)
        for batch in batches:
            if batch.num_rows:
                found = square_sums(_less(batch, middle))
                total = [a + b for a, b in zip(total, found)]
        yield pa.record_batch([pa.array([[str(t) for t in total]], pa.list_(pa.string()))], names=["squares"])

    parts = fit.select("x").mapInArrow(add, "squares array<string>")
    cells = parts.select(F.posexplode("squares").alias("at", "square"))
    added = cells.groupBy("at").agg(F.sum(F.col("square").cast("decimal(38,0)")).alias("square"))
    squares = {r["at"]: int(r["square"]) for r in added.collect()}
    rest = [s - n * m for s, m in zip(sums, middle)]
    out = []
    for at, (i, j) in enumerate(pair_places(d)):
        r = rest[i] + rest[j] if i != j else rest[i]
        out.append(n * n * squares[at] - n * r * r)
    return out


def polarised_covariance(squares: list[int], n: int, d: int):
    """The covariance matrix, divisor n, from centred sums of squares (of n times the values)."""
    import numpy as np

    of = dict(zip(pair_places(d), squares))
    v = np.empty((d, d))
    for (i, j), both in of.items():
        # Whole numbers up to the one division, which rounds correctly.
        v[i, j] = v[j, i] = of[i, i] / n**3 if i == j else (both - of[i, i] - of[j, j]) / (2 * n**3)
    return v


def components(v, count: int = COMPONENTS):
    """Eigenvalues, unit eigenvectors (columns) and shares of variance, largest first.

    The largest entry of an eigenvector is positive. A component without
    variance has eigenvalue 0.
    """
    import numpy as np

    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:count]
    values, vectors = values[order], vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(order))] < 0, -1.0, 1.0)
    whole = float(np.trace(v))
    values = np.where(values > NO_VARIANCE * whole, values, 0.0)
    return values, vectors, values / whole if whole > 0 else np.zeros(len(values))


def _projected(rows: DataFrame, keep: list[str], schema: str, n: int, sums: list[int], values, vectors) -> DataFrame:
    """``keep`` and, per row, ``deviation`` (as decimal) and ``whitened`` (a list)."""
    import numpy as np

    middle = [s // n for s in sums]
    fraction = np.array([(s - n * m) / n for s, m in zip(sums, middle)])
    rest = [s - n * m for s, m in zip(sums, middle)]
    root = np.sqrt(values)
    scaled = np.where(root > 0, vectors / np.where(root > 0, root, 1.0), 0.0)
    count = scaled.shape[1]

    def project(batches) -> Iterator:
        import decimal

        import numpy as np
        import pyarrow as pa

        most = decimal.Decimal(10) ** 38
        for batch in batches:
            z = _less(batch, middle)
            # sum (n z - r)^2 = n^2 sum z^2 - 2 n sum r z + sum r^2
            squares, crossed = (z * z).sum(axis=1), z.astype(object) @ np.array(rest, object)
            own = sum(r * r for r in rest)
            off = [decimal.Decimal(n * n * int(a) - 2 * n * int(b) + own) for a, b in zip(squares, crossed)]
            whitened = (z.astype(np.float64) - fraction) @ scaled
            offsets = np.arange(0, whitened.size + 1, count, dtype="i4")
            yield pa.record_batch(
                [batch.column(k) for k in keep]
                + [
                    pa.array([o if o < most else None for o in off], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(whitened.reshape(-1))),
                ],
                names=[*keep, "deviation", "whitened"],
            )

    return rows.mapInArrow(project, schema + "deviation decimal(38,0), whitened array<double>")


def identity_error(fit: DataFrame, n: int, sums: list[int], values, vectors) -> float:
    """The largest entry of the whitened covariance minus the identity, over components with variance."""
    live = [k for k, e in enumerate(values) if e > 0]
    if not live:
        return 0.0
    whitened = _projected(fit, [], "", n, sums, values, vectors)
    w = [F.get("whitened", F.lit(k)) for k in live]
    means = [F.avg(x).alias(f"m{a}") for a, x in enumerate(w)]
    products = [F.avg(w[a] * w[b]).alias(f"p{a}_{b}") for a in range(len(w)) for b in range(a, len(w))]
    got = whitened.agg(*means, *products).head()
    return max(
        abs(got[f"p{a}_{b}"] - got[f"m{a}"] * got[f"m{b}"] - (1.0 if a == b else 0.0))
        for a in range(len(w)) for b in range(a, len(w))
    )


def whiten(
    embeddings: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per remaining row of ``embeddings`` and component.

    Columns: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``. Null vectors and vectors with null or non-finite entries
    are dropped. All others must be of one length; where they are not, those of
    the most frequent length (the longest of several) remain. Repeated rows and
    null ids remain, each with its own result; equal vectors count once in the
    fit. A component without variance (one distinct vector, or fewer dimensions
    of variation than components) has whitened 0 and explained 0 and takes no
    part in identity_error. A deviation beyond a long is null. Vectors without
    entries, and an empty table, give no rows.
    """
    spark = embeddings.sparkSession
    rows = lattice(embeddings, id_col, vector_col)
    distinct = tables.stored(rows.groupBy("x").agg(F.count("*").alias("copies")), "fit-vectors")
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("rows")).collect()
    d = max(((r["rows"], r["d"]) for r in lengths), default=(0, 0))[1]
    if not d:
        return spark.createDataFrame([], RESULT + ", identity_error double")
    one_length = F.size("x") == d
    rows = rows.where(one_length)
    fit = distinct.where(one_length).select("x") if len(lengths) > 1 else distinct.select("x")
    n, sums = _totals(fit)
    squares = centred_squares(fit, n, sums)
    values, vectors, shares = components(polarised_covariance(squares, n, d), count)
    error = identity_error(fit, n, sums, values, vectors)
    out = _projected(rows, ["vec_id"], "vec_id bigint, ", n, sums, values, vectors)
    explained = F.array(*[F.lit(float(s)) for s in shares])
    return out.select(
        "vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
