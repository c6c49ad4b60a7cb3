"""Toxicity by weak supervision.

Voters are lexicons and patterns. The lexicons are a short list of insults and
terms (words and beginnings of words) that a bounded sample of labelled rows
shows to be used, in several surroundings, in toxic texts only; each term belongs
to one voter. Whether a term qualifies is judged by a confidence bound, so the same
test serves few labelled rows and many, and where no term qualifies the insults
and patterns vote alone. One pass counts every voter's hits in every document.

A generative label model explains the votes by one hidden label: the covariance
of two voters that are independent given the label is the product of their
strengths, so strengths follow from all pairs' covariances, and what a pair's
covariance exceeds that product by is its correlation. The model gives every
training row a posterior label, with correlated voters counting less; a linear
classifier trained on these posteriors scores all documents.

Labels are used for choosing terms, the share of toxic rows, and training, from
rows that are not held out. Scores depend on the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseforge.llm import tables
from clauseforge.llm.tokens import rows_of

# Labelled rows that terms are chosen from and the classifier is trained on, at most.
SAMPLE = 20_000
FOLDS = 5
# A term needs two different surroundings in toxic texts, and more where there are
# many of these: one for so many distinct toxic texts of the sample.
SURROUNDINGS_PER_TEXT = 0.02
# The share of its texts that are toxic must be at least this, at the lower end of
# its confidence interval (Wilson, one deviation).
PURITY = 0.7
# Lexicons of terms above each purity, so many of each.
TIERS = (0.97, 0.9, PURITY)
PER_TIER = 4
LEXICONS = len(TIERS) * PER_TIER
BEGINNINGS = (4, 5, 6, 7, 8)
# Lexicon hits per hundred words at which two further voters vote.
DENSITIES = (1, 3)

INSULTS = frozenset(
    "idiot idiots stupid moron morons dumb loser losers pathetic disgusting scum trash worthless"
    " clown ugly hate fool jerk garbage filthy imbecile retard bastard bitch crap shit fuck kill".split()
)
PATTERNS = (
    re.compile(r"\b(?:you|you're|your)\s+(?:are\s+)?(?:all\s+)?(?:an?\s+|the\s+)?(?:such\s+)?(?:idiot|moron|loser|clown)", re.I),
    re.compile(r"\b(?:shut up|go away|drop dead|get lost)\b", re.I),
    re.compile(r"[!?]{3,}"),
    re.compile(r"\b[A-Z]{4,}(?:\W+[A-Z]{4,}){2,}"),
    re.compile(r"[@#$%*]{3,}"),
)
N_VOTERS = LEXICONS + 1 + len(PATTERNS) + len(DENSITIES)

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """One fold in five, by the CRC-32 of the id as text."""
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings; a beginning ends with ``*``."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) >= n]]


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``sample`` labelled rows that are not held out."""
    known = (
        tables.pick(labels, "doc_id", "toxic")
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of two numbers.
    return tables.stored(docs.join(F.broadcast(drawn), "doc_id"), "toxic-sample")


def purity_bound(toxic: Column, texts: Column) -> Column:
    """Lower end of the one-deviation Wilson interval of ``toxic / texts``."""
    share = toxic / texts
    spread = F.sqrt(share * (1 - share) / texts + 1 / (4 * texts * texts))
    return (share + 1 / (2 * texts) - spread) / (1 + 1 / texts)


def choose_terms(sample: DataFrame) -> dict[str, int]:
    """The terms that qualify and the voter of each; their number is bounded by the sample's texts."""

    def surroundings(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            rows = set()
            for (text,) in rows_of(batch, "text"):
                before = ""
                for word in _WORD.findall(text.lower()):
                    near = xxhash.xxh3_64_intdigest(before) >> 1
                    rows.update((term, near) for term in terms_of(word))
                    before = word
            terms, near = zip(*rows) if rows else ((), ())
            yield pa.record_batch(
                [pa.array(terms, pa.string()), pa.array(near, pa.int64())], names=["term", "near"]
            )

    def text_counts(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in rows_of(batch, "text", "toxic"):
                words = set(_WORD.findall(text.lower()))
                for term in {t for w in words for t in terms_of(w)}:
                    count = found.setdefault(term, [0, 0])
                    count[0] += toxic
                    count[1] += 1
            yield pa.record_batch(
                [
                    pa.array(list(found), pa.string()),
                    pa.array([c[0] for c in found.values()], pa.int64()),
                    pa.array([c[1] for c in found.values()], pa.int64()),
                ],
                names=["term", "toxic", "texts"],
            )

    # A text that is repeated tells no more than once.
    texts = sample.select("text", F.col("toxic").cast("int").alias("toxic")).distinct()
    toxic = texts.where("toxic = 1").select("text")
    least = max(2, round(SURROUNDINGS_PER_TEXT * toxic.count()))
    used = (
        toxic.mapInArrow(surroundings, "term string, near bigint")
        .groupBy("term").agg(F.count_distinct("near").alias("n"))
        .where(F.col("n") >= least)
    )
    counted = (
        texts.mapInArrow(text_counts, "term string, toxic bigint, texts bigint")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"))
        .where(F.col("toxic") >= PURITY * F.col("texts"))
        .withColumn("purity", purity_bound(F.col("toxic"), F.col("texts")))
        .where(F.col("purity") >= PURITY)
    )
    best = sorted(used.join(counted, "term").select("term", "n", "purity").collect(), key=lambda r: (-r["n"], r["term"]))
    # Within a tier turn by turn, so that voters have terms of every frequency.
    voters = {}
    for tier, (lower, upper) in enumerate(zip(TIERS, (2.0, *TIERS))):
        inside = [r["term"] for r in best if lower <= r["purity"] < upper]
        voters |= {term: tier * PER_TIER + n % PER_TIER for n, term in enumerate(inside)}
    return voters


def voter_hits(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """``doc_id, hits`` of every row of ``docs (doc_id, text)``.

    ``hits`` has one count per voter and then the number of words.
    """

    def count(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        # What a word adds is looked up once per worker task.
        known: dict[str, tuple[int, ...]] = {}

        def voters(word: str) -> tuple[int, ...]:
            found = [terms[t] for t in terms_of(word) if t in terms]
            return tuple(found + [LEXICONS] * (word in INSULTS))

        for batch in batches:
            grid = np.zeros((batch.num_rows, N_VOTERS + 1), "i4")
            for row, (text,) in enumerate(rows_of(batch, "text")):
                words = _WORD.findall(text.lower())
                grid[row, N_VOTERS] = len(words)
                for word in words:
                    got = known.get(word)
                    if got is None:
                        if len(known) > 300_000:
                            known.clear()
                        got = known[word] = voters(word)
                    for voter in got:
                        grid[row, voter] += 1
                for n, pattern in enumerate(PATTERNS, start=LEXICONS + 1):
                    grid[row, n] = sum(1 for _ in pattern.finditer(text))
            in_lexicons = grid[:, : LEXICONS + 1].sum(axis=1)
            for n, density in enumerate(DENSITIES, start=N_VOTERS - len(DENSITIES)):
                grid[:, n] = (100 * in_lexicons >= density * grid[:, N_VOTERS]) & (in_lexicons > 0)
            offsets = np.arange(0, grid.size + 1, N_VOTERS + 1, dtype="i4")
            hits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(grid.reshape(-1)))
            yield pa.record_batch([batch.column("doc_id"), hits], names=["doc_id", "hits"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id bigint, hits array<int>")


def moments(hits: DataFrame):
    """How often each pair of voters votes together, and each alone, over all documents."""

    def add(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total, rows = np.zeros((N_VOTERS, N_VOTERS), "i8"), 0
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("hits").flatten().to_numpy()
                votes = (flat.reshape(-1, N_VOTERS + 1)[:, :N_VOTERS] > 0).astype("i8")
                total += votes.T @ votes
                rows += len(votes)
        yield pa.record_batch(
            [pa.array([total.reshape(-1).tolist()], pa.list_(pa.int64())), pa.array([rows], pa.int64())],
            names=["together", "rows"],
        )

    import numpy as np

    sums = hits.select("hits").mapInArrow(add, "together array<bigint>, rows bigint")
    cells = sums.select("rows", F.posexplode("together").alias("cell", "n"))
    got = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()
    together = np.zeros(N_VOTERS * N_VOTERS)
    for r in got:
        together[r["cell"]] = r["n"]
    return together.reshape(N_VOTERS, N_VOTERS), (got[0]["rows"] if got else 0)


def label_model(together, rows: int, share: float) -> tuple[list[float], list[float], list[float]]:
    """Per voter: its vote rates for toxic and for other texts, and its weight.

    ``share`` is the share of toxic texts. The weight is one over one plus the
    correlations with other voters that the label does not explain.
    """
    import numpy as np

    mean = np.diag(together) / rows
    cov = together / rows - np.outer(mean, mean)
    spread = share * (1 - share)
    strength = np.zeros(N_VOTERS)
    live = [i for i in range(N_VOTERS) if mean[i] > 0]
    for i in live:
        # From each pair of other voters, the strength of this one.
        found = [
            cov[i, j] * cov[i, k] / cov[j, k]
            for j in live for k in live
            if i != j < k != i and cov[j, k] > 1e-9 and cov[i, j] > 0 and cov[i, k] > 0
        ]
        if found:
            strength[i] = min(float(np.sqrt(np.median(found))), mean[i] * (1 - share) / spread**0.5)
    difference = strength / spread**0.5
    if_other = np.clip(mean - share * difference, 1e-4, 0.999)
    if_toxic = np.clip(if_other + difference, 1e-4, 0.999)
    sigma = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    left = (cov - np.outer(strength, strength)) / np.outer(sigma, sigma)
    np.fill_diagonal(left, 0)
    weight = 1 / (1 + np.clip(left, 0, 1).sum(axis=1))
    return if_toxic.tolist(), if_other.tolist(), weight.tolist()


def _votes_log_odds(if_toxic, if_other, weight, share: float) -> Column:
    from math import log

    total = F.lit(log(share / (1 - share)))
    for i, (t, o, w) in enumerate(zip(if_toxic, if_other, weight)):
        if t > o:
            vote = F.when(F.col("hits")[i] > 0, w * log(t / o)).otherwise(w * log((1 - t) / (1 - o)))
            total = total + vote
    return total


def _inputs() -> list[Column]:
    """Per voter whether it votes, how often, and how densely; the last two damped."""
    words = F.greatest(F.lit(1), F.col("hits")[N_VOTERS])
    out = []
    for i in range(N_VOTERS):
        hit = F.col("hits")[i]
        out += [
            (hit > 0).cast("double"),
            F.log1p(hit.cast("double")),
            F.log1p(1000.0 * hit / words),
        ]
    return out


def score_documents(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts have no hits and get the score that this gives. A null
    id is not held out. Where labelled rows of both kinds are not there to learn
    from, every score is the share of toxic labels (0 without labels); without
    terms the insults and patterns decide. Repeated rows are scored each; an empty
    table gives no rows.
    """
    plain = tables.documents(docs, id_col, text_col)
    drawn = training_sample(plain, labels, sample)
    kinds = {
        r["toxic"]: r["n"] for r in drawn.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    }
    share = kinds.get(1, 0) / max(1, sum(kinds.values()))
    out = plain.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    if not 0 < share < 1:
        return out.withColumn("score", F.lit(float(share))).withColumn(
            "predicted", (F.col("score") >= 0.5).cast("int")
        )
    hits = tables.stored(voter_hits(plain, choose_terms(drawn)), "voter-hits")
    together, rows = moments(hits)
    model = label_model(together, rows, share)
    odds = _votes_log_odds(*model, share)
    ids = drawn.select("doc_id").distinct()
    # The sample's ids are bounded; every copy of a row has the same hits.
    train = (
        hits.join(F.broadcast(ids), "doc_id")
        .select(array_to_vector(F.array(*_inputs())).alias("features"), (1 / (1 + F.exp(-odds))).alias("posterior"))
        .coalesce(4)
    )
    train = tables.stored(
        train.select("features", F.lit(1.0).alias("label"), F.col("posterior").alias("weight")).union(
            train.select("features", F.lit(0.0), 1 - F.col("posterior"))
        ),
        "posterior-labels",
    )
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=60).fit(train)
    coefficients = fitted.coefficients.toArray().tolist()
    margin = F.lit(float(fitted.intercept))
    for coefficient, value in zip(coefficients, _inputs()):
        margin = margin + coefficient * value
    return hits.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        (1 / (1 + F.exp(-margin))).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
