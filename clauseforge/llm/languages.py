"""Language identification with a convolutional network over bytes.

A text is read as UTF-8 in windows of ``WINDOW`` bytes that overlap by one byte
less than the widest filter, so every place of a text is seen by every filter.
The network looks up a vector for each byte, applies filters of several widths,
takes each filter's largest response in the window (at least 0), and turns these
into probabilities with a linear layer and softmax. A text has the mean of its
windows' probabilities, weighted by their bytes.

The network is trained in numpy on the driver with a bounded sample: at most
``SAMPLE`` texts, evenly from all languages and each text once however often it
is repeated, of which ``CROPS`` windows each are taken. In tasks, the responses to
two neighbouring bytes are looked up in tables made from the same numbers, which
is the same network with fewer multiplications.

Languages and ids are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseforge.llm import tables
from clauseforge.llm.tokens import rows_of

FOLDS, HELD_OUT = 4, 2
# The network.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
BYTE_VECTOR = 8
# Training: texts at most, windows of each, and steps of gradient descent.
SAMPLE = 4_000
CROPS = 4
SHORTEST_CROP = 12
STEPS, BATCH, RATE = 700, 96, 0.01
SEED = 20
# Windows whose responses are in memory at once.
AT_ONCE = 64

UNDETERMINED = "und"
SPREAD = 1 << 20


@dataclass(frozen=True)
class Network:
    """Byte vectors, filters by width (width * BYTE_VECTOR, FILTERS), the last layer, and its languages."""

    languages: list[str]
    bytes: object
    filters: list
    weight: object
    bias: object

    @property
    def widest(self) -> int:
        return max(WIDTHS)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


# Training


def training_windows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, bytes]]:
    """``(language, window)`` of at most about ``sample`` texts, evenly by language."""
    known = docs.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
        & has_letter(F.col("text"))
    ).select("lang", "text", F.xxhash64("text").alias("h"))
    # Equal texts are one row per task before the shuffle.
    sizes = known.groupBy("lang", "h").count().groupBy("lang").agg(F.count("*").alias("texts"))
    sizes = {r["lang"]: r["texts"] for r in sizes.collect()}
    if not sizes:
        return []
    share = max(1, sample // len(sizes))
    # One number per language.
    shares = [(lang, int(min(1.0, share / n) * SPREAD)) for lang, n in sizes.items()]
    wanted = docs.sparkSession.createDataFrame(shares, "lang string, below bigint")
    drawn = known.join(F.broadcast(wanted), "lang").where(F.pmod("h", F.lit(SPREAD)) < F.col("below"))

    def crop(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            langs, crops = [], []
            for lang, text, h in rows_of(batch, "lang", "text", "h"):
                raw, draw = text.encode(), np.random.default_rng(h % (1 << 63))
                for _ in range(CROPS):
                    start = int(draw.integers(0, max(1, len(raw) - WINDOW + 1)))
                    langs.append(lang)
                    crops.append(raw[start : start + WINDOW])
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(crops, pa.binary())], names=["lang", "crop"])

    windows = drawn.mapInArrow(crop, "lang string, crop binary").distinct()
    return sorted((r["lang"], bytes(r["crop"])) for r in windows.collect())


def _grid(windows: list[bytes]):
    """Windows as rows of bytes, filled up with zeros."""
    import numpy as np

    out = np.zeros((len(windows), WINDOW), "u1")
    for row, raw in enumerate(windows):
        out[row, : len(raw)] = np.frombuffer(raw, "u1")
    return out


def train(windows: list[tuple[str, bytes]], steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit the network by gradient descent (Adam) on cross-entropy, every language equally often.

    Half of the windows of a step are cut to a random length, so that short texts are learnt too.
    """
    import numpy as np

    languages = sorted({lang for lang, _ in windows})
    draw = np.random.default_rng(seed)
    grid = _grid([raw for _, raw in windows])
    lengths = np.array([len(raw) for _, raw in windows])
    of = np.array([languages.index(lang) for lang, _ in windows])
    rows_by_language = [np.flatnonzero(of == k) for k in range(len(languages))]
    normal = lambda scale, *shape: draw.normal(0, scale, shape).astype("f4")
    params = [normal(0.5, 256, BYTE_VECTOR)]
    params += [normal((w * BYTE_VECTOR) ** -0.5, w * BYTE_VECTOR, FILTERS) for w in WIDTHS]
    params += [normal(0.1, len(WIDTHS) * FILTERS, len(languages)), np.zeros(len(languages), "f4")]
    params[0][0] = 0  # filling has no response
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        label = draw.integers(0, len(languages), BATCH)
        chosen = np.array([draw.choice(rows_by_language[k]) for k in label])
        batch = grid[chosen].copy()
        shorter = draw.random(BATCH) < 0.5
        cut = draw.integers(SHORTEST_CROP, WINDOW + 1, BATCH)
        for row in np.flatnonzero(shorter & (cut < lengths[chosen])):
            batch[row, cut[row] :] = 0
        grads = _gradients(params, batch, label)
        rate = RATE * (1 - step / (steps + 1))
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return Network(languages, params[0], params[1:-2], params[-2], params[-1])


def _gradients(params: list, batch, label) -> list:
    """Gradients of the mean cross-entropy of a batch; only a filter's best place takes part."""
    import numpy as np

    table, *filters, weight, bias = params
    vectors = table[batch]
    pooled, places = [], []
    for width, w in zip(WIDTHS, filters):
        spans = np.lib.stride_tricks.sliding_window_view(vectors, width, axis=1)
        spans = spans.transpose(0, 1, 3, 2).reshape(len(batch), -1, width * BYTE_VECTOR)
        response = spans @ w
        place = response.argmax(axis=1)
        pooled.append(np.take_along_axis(response, place[:, None, :], 1)[:, 0])
        places.append((spans, place))
    hidden = np.concatenate(pooled, axis=1)
    active = hidden > 0
    hidden = hidden * active
    logits = hidden @ weight + bias
    soft = _softmax(logits)
    soft[np.arange(len(batch)), label] -= 1
    soft /= len(batch)
    back = (soft @ weight.T) * active
    grads = [np.zeros_like(table)]
    for n, (width, w, (spans, place)) in enumerate(zip(WIDTHS, filters, places)):
        part = back[:, n * FILTERS : (n + 1) * FILTERS]
        best = np.take_along_axis(spans, place[:, :, None], 1)
        grads.append(np.einsum("bf,bfk->kf", part, best))
        into = (part[:, :, None] * w.T[None]).reshape(len(batch), FILTERS, width, BYTE_VECTOR)
        for k in range(width):
            np.add.at(grads[0], np.take_along_axis(batch, place + k, 1), into[:, :, k])
    grads[0][0] = 0
    return [*grads, hidden.T @ soft, soft.sum(axis=0)]


def _softmax(logits):
    import numpy as np

    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# Prediction


def pair_tables(net: Network) -> list:
    """Per two bytes of the widest filter, the responses to every pair of them.

    A table has the filters that are wide enough, narrow ones first left out, so its
    columns are the last ones of all filters.
    """
    import numpy as np

    out = []
    for at in range(0, net.widest, 2):
        columns = []
        for width, w in zip(WIDTHS, net.filters):
            if width <= at:
                continue
            cut = w.reshape(width, BYTE_VECTOR, FILTERS)
            table = (net.bytes @ cut[at])[:, None, :]
            if width > at + 1:
                table = table + (net.bytes @ cut[at + 1])[None, :, :]
            columns.append(np.broadcast_to(table, (256, 256, FILTERS)))
        out.append(np.concatenate(columns, axis=2).reshape(1 << 16, -1).astype("f4"))
    return out


def windows_of(raw: bytes):
    """The windows of a text as rows of bytes, and the bytes that each one adds."""
    import numpy as np

    step = WINDOW - max(WIDTHS) + 1
    count = max(1, -(-(len(raw) - max(WIDTHS) + 1) // step))
    padded = np.zeros((count - 1) * step + WINDOW, "u1")
    padded[: len(raw)] = np.frombuffer(raw, "u1")
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]
    added = np.full(count, step)
    added[-1] = max(1, len(raw) - (count - 1) * step)
    return rows, added


def probabilities(net: Network, looked_up: list, rows):
    """Per window (a row of bytes) the probability of every language."""
    import numpy as np

    out = np.empty((len(rows), len(net.languages)))
    for start in range(0, len(rows), AT_ONCE):
        part = np.zeros((len(rows[start : start + AT_ONCE]), WINDOW + net.widest), np.intp)
        part[:, :WINDOW] = rows[start : start + AT_ONCE]
        pairs = (part[:, :-1] << 8) | part[:, 1:]
        response = looked_up[0].take(pairs[:, :WINDOW], axis=0)
        for n, table in enumerate(looked_up[1:], start=1):
            response[:, :, -table.shape[1] :] += table.take(pairs[:, 2 * n : WINDOW + 2 * n], axis=0)
        hidden = np.maximum(response.max(axis=1), 0)
        out[start : start + AT_ONCE] = _softmax(hidden @ net.weight + net.bias)
    return out


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of ``docs (doc_id, held_out, text, lettered)``."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        looked_up = pair_tables(net)
        for batch in batches:
            langs, scores = [], []
            # Windows of many texts go through the network together.
            for texts in _bounded(rows_of(batch, "text", "lettered")):
                cut = [windows_of(text.encode()) if lettered else None for text, lettered in texts]
                rows = [c[0] for c in cut if c]
                found = probabilities(net, looked_up, np.concatenate(rows)) if rows else None
                at = 0
                for c in cut:
                    if c is None:
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    mean = np.average(found[at : at + len(c[1])], axis=0, weights=c[1])
                    at += len(c[1])
                    best = int(mean.argmax())
                    langs.append(net.languages[best])
                    scores.append(float(min(1.0, mean[best])))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def _bounded(rows, size: int = 1 << 18) -> Iterator[list]:
    """Rows in groups of about ``size`` characters."""
    group, chars = [], 0
    for row in rows:
        group.append(row)
        chars += len(row[0])
        if chars >= size:
            yield group
            group, chars = [], 0
    if group:
        yield group


def identify(
    docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``.

    Learnt from rows with an id that is not held out, a language, and a letter
    in the text. Texts without a letter, null ones included, are ``und`` with score
    0; so is every text where there is nothing to learn from. With a single language
    it is predicted with score 1. Equally probable languages: the first by name.
    Null ids are not held out. Repeated rows are predicted each; an empty table
    gives no rows.
    """
    tables.ship(docs.sparkSession)
    plain = tables.pick(docs, id_col, text_col, lang_col).select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"),
    )
    windows = training_windows(plain, sample)
    rows = plain.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", has_letter(F.col("text")).alias("lettered")
    )
    if not windows:
        return rows.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return predict(rows, train(windows, steps))
