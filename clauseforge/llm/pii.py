"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Generators propose spans in one scan of the texts; only texts with a match go
on. Spans of the four base kinds that pass their check are always found.
Spans of the further kinds are scored by gradient-boosted trees over their format and
context, trained here on weak labels (a keyword before a candidate or before the same match
elsewhere), and found where they are labelled, begin with a fixed key prefix, or
their score reaches a threshold that all candidates of the kind set, each scored by
trees that have not seen its match. Everything is DataFrame operations and Spark ML.

Places of matches follow from the lengths of the texts between them: splitting
by a pattern and extracting its matches give alternating pieces of the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseforge.llm import tables

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "number", "mail")
KINDS = BASE_KINDS + MORE_KINDS

PRECISION = 0.95
# The threshold of a kind of which no labelled candidate sets one.
DEFAULT = 0.5
# Formats of which fewer matches stand after a keyword are not taken for it.
LEAST = 0.2
LEFT, RIGHT = 32, 16

_LOCAL = "[A-Za-z0-9._%+-]"
# Repetitions that cannot give back are possessive: no text makes them recurse
# or try again. \G stands for the end of the match before.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{12,}+",
    "number": r"(?<![0-9A-Za-z.+])[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "mail": rf"(?<!{_LOCAL}){_LOCAL}{{2,}}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++"
    r" ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,}+",
}
# A text without these has no match.
_NEEDS = {"email": "@", "mail": "dot", "phone": "+"}

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_WORDS_BEFORE = {
    "secret": r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_ -]?key|key|auth|bearer)[\s=:\"'>-]{0,6}$",
    "number": r"(?i)(?:tel|phone|call|fax|mobile|ssn|social security|passport|account|iban|card)\S{0,4}[\s=:#\"'.]{0,4}$",
    "mail": r"(?i)(?:mail|contact|write|reach)\b.{0,24}$",
}
_KEY_PREFIX = r"^(?:AKIA|ASIA|ghp_|gho_|xox[abp]-|sk-|pk_|AIza|eyJ)"

FORMAT = (
    "changes", "hex_share", "length", "digits", "lower", "upper", "digit_share", "dashes", "dots",
    "blanks", "marks", "head", "tail", "kind_no",
)
# The words before a match give the labels. They are not among these, or the
# trees would learn the keywords again.
CONTEXT = (
    "then_blank", "then_stop", "then_quote", "then_nothing", "ends_line", "digits_around", "upper_around",
    "near",
)
FEATURES = FORMAT + CONTEXT
# Other candidates count as near within so many characters.
NEAR = 64


def _matches(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def proposals(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text_hash, hits`` of every row of ``docs (doc_id, text)``, stored.

    ``hits`` lists the matches of every generator with the length of the text
    between it and the match before, and what stands around it.
    """
    marked = docs.withColumn("digit", F.col("text").rlike("[0-9]"))
    for kind in KINDS:
        need = F.col("text").contains(_NEEDS[kind]) if kind in _NEEDS else F.col("digit")
        empty = F.array().cast("array<string>")
        marked = marked.withColumn(
            f"{kind}_found", F.when(need, _matches(F.col("text"), kind)).otherwise(empty)
        )
    for kind in KINDS:
        some = F.size(f"{kind}_found") > 0
        empty = F.array().cast("array<string>")
        marked = marked.withColumn(
            f"{kind}_between",
            F.when(some, F.split("text", PATTERNS[kind], -1)).otherwise(empty),
        )

    def listed(kind: str) -> Column:
        between = F.col(f"{kind}_between")
        return F.transform(
            f"{kind}_found",
            lambda match, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("nth"),
                match.alias("match"),
                F.length(F.get(between, i)).alias("gap"),
                F.right(F.get(between, i), F.lit(LEFT)).alias("left"),
                F.left(F.get(between, i + 1), F.lit(RIGHT)).alias("right"),
            ),
        )

    return tables.stored(
        marked.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.xxhash64("text").alias("text_hash"),
            F.concat(*[listed(kind) for kind in KINDS]).alias("hits"),
        ),
        "proposals",
    )


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        digit = F.substring(back, i, F.lit(1)).cast("int")
        twice = 2 * digit - F.when(digit > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(digit)

    total = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, b: a + b
    )
    return total % 10 == 0


def spans(proposed: DataFrame) -> DataFrame:
    """One row per candidate: ``row, kind, start, end, match, left, right, valid``.

    ``start`` and ``end`` count code points; ``valid`` holds for matches of a
    base kind that pass its check.
    """
    each = proposed.where(F.size("hits") > 0).select("row", F.inline("hits"))
    order = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(
        Window.unboundedPreceding, 0
    )
    length = F.length("match")
    digits = F.regexp_replace("match", "[^0-9]", "")
    n_digits = F.length(digits)
    valid = (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", F.col("match").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(
            F.col("kind") == "card",
            F.when(n_digits.between(12, 19), _luhn(digits)).otherwise(F.lit(False)),
        )
        .when(F.col("kind") == "phone", n_digits.between(9, 15))
        .otherwise(F.lit(False))
    )
    return (
        each.withColumn("end", F.sum(F.col("gap") + length).over(order))
        .withColumn("start", F.col("end") - length)
        .withColumn("valid", valid)
        .select("row", "kind", "start", "end", "match", "left", "right", "valid")
    )


def with_features(candidates: DataFrame) -> DataFrame:
    """The candidates of the further kinds, without those inside valid base spans, with
    features of their format and context and weak labels.

    ``label`` holds where a keyword stands before the candidate, or before the
    same match elsewhere. ``settled`` ones share a place with a valid base span.
    """
    kinds, valid = F.col("kind").isin(*MORE_KINDS), F.col("valid")
    order = Window.partitionBy("row").orderBy("start", F.desc("valid"))
    reached = F.max(F.when(valid, F.col("end"))).over(
        order.rowsBetween(Window.unboundedPreceding, -1)
    )
    next_base = F.min(F.when(valid, F.col("start"))).over(
        order.rowsBetween(1, Window.unboundedFollowing)
    )
    around_it = Window.partitionBy("row").orderBy("start").rangeBetween(-NEAR, NEAR)
    match, left, right = F.col("match"), F.col("left"), F.col("right")
    after, around = F.left(right, F.lit(1)), F.concat(left, right)

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(match, f"[^{pattern}]", "")).cast("double")

    def run(pattern: str) -> Column:
        return F.length(F.regexp_extract(match, pattern, 0)).cast("double")

    def then(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("double")

    def share(pattern: str) -> Column:
        # In tenths, so that equal rows of features stay many.
        found = F.length(F.regexp_replace(around, f"[^{pattern}]", ""))
        return F.round(10 * found / F.greatest(F.length(around), F.lit(1))).cast("double")

    length = F.length(match).cast("double")
    of_kind = lambda patterns, c: reduce(
        lambda a, k: a | ((F.col("kind") == k) & c.rlike(patterns[k])), MORE_KINDS, F.lit(False)
    )
    kind_no = F.coalesce(
        *[F.when(F.col("kind") == k, float(i)) for i, k in enumerate(MORE_KINDS)]
    )
    described = tables.stored(
        candidates.where(kinds | valid)
        .withColumn("reached", reached).withColumn("next_base", next_base)
        .withColumn("near", F.least(F.count("*").over(around_it) - 1, F.lit(9)).cast("double"))
        .where(kinds & (F.coalesce("reached", F.lit(0)) < F.col("end")))
        .select(
            "row", "kind", "start", "end", "match",
            (
                F.coalesce(F.col("reached") > F.col("start"), F.lit(False))
                | F.coalesce(F.col("next_base") < F.col("end"), F.lit(False))
            ).alias("settled"),
            # Switches between digits and letters.
            F.regexp_count(match, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"))
            .cast("double").alias("changes"),
            (count("0-9a-fA-F") / length).alias("hex_share"),
            length.alias("length"),
            count("0-9").alias("digits"),
            count("a-z").alias("lower"),
            count("A-Z").alias("upper"),
            (count("0-9") / length).alias("digit_share"),
            count("-").alias("dashes"),
            count(".").alias("dots"),
            count(" ").alias("blanks"),
            count(r"()@\[\]_/+").alias("marks"),
            run("^[0-9]*").alias("head"),
            run("[0-9]*$").alias("tail"),
            kind_no.alias("kind_no"),
            then(after == " ").alias("then_blank"),
            then(after.rlike(r"[.,;:!?)\]]")).alias("then_stop"),
            then(after.rlike("[\"'<>`]")).alias("then_quote"),
            then(after == "").alias("then_nothing"),
            then(right.rlike(r"^\W*(?:\n|$)")).alias("ends_line"),
            share("0-9").alias("digits_around"),
            share("A-Z").alias("upper_around"),
            "near",
            F.pmod(F.xxhash64("match"), F.lit(2)).alias("fold"),
            of_kind(_WORDS_BEFORE, left).alias("keyword"),
            match.rlike(_KEY_PREFIX).alias("prefix"),
        ),
        "further-candidates",
    )
    marked = tables.stored(
        described.where("keyword and not settled")
        .select(F.col("kind").alias("_kind"), F.col("match").alias("_match")).distinct(),
        "marked-matches",
    )
    return described.join(
        tables.small(marked, marked.count()),
        (F.col("kind") == F.col("_kind")) & (match == F.col("_match")), "left",
    ).withColumn(
        "label", (F.col("keyword") | F.col("_match").isNotNull()).cast("double")
    ).drop("match", "_kind", "_match")


def scored(further: DataFrame) -> DataFrame:
    """``further`` with ``score``, the trees' probability, and ``step``, its hundredths.

    Every candidate that is not settled is used: the trees are fitted on the distinct rows of
    features with their counts as weights. There are two sets of trees, each
    fitted on one half of the distinct matches; a candidate is scored by the
    trees that have not seen its match.
    """
    rows = tables.stored(
        further.where(~F.col("settled")).groupBy("fold", "label", *FEATURES).agg(F.count("*").cast("double").alias("weight")),
        "feature-rows",
    )
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    halves = []
    for fold in (0, 1):
        seen = assembler.transform(rows.where(F.col("fold") != fold)).select("features", "label", "weight")
        unseen = assembler.transform(further.where(F.col("fold") == fold))
        if len(seen.select("label").distinct().take(2)) < 2:
            # Nothing to tell apart.
            share = seen.agg(F.max("label")).first()[0] or 0.0
            halves.append(unseen.drop("features").withColumn("score", F.lit(share)))
            continue
        model = GBTClassifier(
            maxDepth=4, maxIter=8, maxBins=32, seed=7, cacheNodeIds=False, weightCol="weight"
        ).fit(seen)
        halves.append(
            model.transform(unseen)
            .withColumn("score", vector_to_array("probability")[1])
            .drop("features", "rawPrediction", "probability", "prediction")
        )
    return halves[0].unionByName(halves[1]).withColumn("step", F.floor(F.col("score") * 100))


def thresholds(candidates: DataFrame, precision: float = PRECISION) -> dict[str, float]:
    """Per kind the lowest score from which on the wanted precision holds, over all ``candidates``.

    A keyword stands before some of the wanted matches only. Where it stands
    does not depend on their format, so the mean score of the labelled
    candidates of a kind is about the share of wanted ones that have a keyword,
    and a score divided by it about the probability to be wanted. Scores below
    ``LEAST`` or half that share are never enough. ``DEFAULT`` where no labelled candidate sets a
    threshold. At most 101 steps of score for each kind reach the driver.
    """
    steps = candidates.groupBy("kind", "step").agg(
        F.count("*").alias("n"), F.sum("label").alias("good")
    ).collect()
    found = dict.fromkeys(MORE_KINDS, DEFAULT)
    for kind in MORE_KINDS:
        mine = sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["step"])
        middle = lambda r: (r["step"] + 0.5) / 100
        labelled = sum(r["good"] for r in mine)
        if not labelled:
            continue
        share = sum(r["good"] * middle(r) for r in mine) / labelled
        n = good = 0.0
        for r in mine:
            n += r["n"]
            good += r["n"] * middle(r) / share
            if good >= precision * n and middle(r) >= max(LEAST, share / 2):
                found[kind] = r["step"] / 100
    return found


def selected(candidates: DataFrame) -> DataFrame:
    """``row, kind, start, end`` of the base spans and of the further ones that are taken.

    A labelled candidate and one with a key prefix are taken in a table of any
    size; the trees add those whose score reaches the threshold. Spans may
    overlap; a further span inside a base span is left out.
    """
    base = candidates.where("valid").select("row", "kind", "start", "end")
    further = tables.stored(with_features(candidates), "labelled-candidates")
    known = (F.col("label") == 1) | F.col("prefix")
    marks = further.where(~F.col("settled")).agg(F.min("label"), F.max("label")).first()
    if marks[0] == marks[1]:
        # Nothing to learn from: the rule alone.
        return base.union(further.where(known).select("row", "kind", "start", "end"))
    judged = tables.stored(
        scored(further).select(
            "row", "kind", "start", "end", "settled", "label", "prefix", "score", "step"
        ),
        "scored",
    )
    limits = thresholds(judged.where(~F.col("settled")))
    least = F.coalesce(*[F.when(F.col("kind") == k, t) for k, t in limits.items()])
    taken = judged.where(known | (F.col("score") >= least)).select("row", "kind", "start", "end")
    return base.union(taken)


def find_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The stored proposals (one row per document) and the stored spans that are kept."""
    proposed = proposals(tables.documents(docs, id_col, text_col))
    candidates = tables.stored(spans(proposed), "candidates")
    return proposed, tables.stored(selected(candidates), "spans")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, counts of the base kinds, ``base_sha256, spans``.

    Null and empty texts have no spans. Repeated rows and null ids are rows of
    their own; an empty table gives no rows; further columns are left out.
    """
    proposed, found = find_spans(docs, id_col, text_col)
    place = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    one = F.struct(
        F.col("start"), place.alias("place"), F.col("end"),
        F.concat_ws(":", "kind", "start", "end").alias("name"),
    )
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE_KINDS]
    # The spans of one document.
    listed = found.groupBy("row").agg(*counts, F.array_sort(F.collect_list(one)).alias("all"))
    base = F.filter("all", lambda s: s["place"] < len(BASE_KINDS))
    names = lambda spans: F.array_join(F.transform(spans, lambda s: s["name"]), ",")
    described = listed.select(
        "row", *[f"n_{k}" for k in BASE_KINDS], names(base).alias("base"),
        names(F.col("all")).alias("spans"),
    )
    return proposed.select("row", "doc_id").join(described, "row", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span in its text replaced by its kind in brackets.

    Spans that overlap are replaced together, under the kind that begins first.
    A null text stays null.
    """
    proposed, found = find_spans(docs, id_col, text_col)
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    merged = (
        found.withColumn("reached", F.max("end").over(earlier))
        .withColumn(
            "group",
            F.sum(F.when(F.col("start") < F.col("reached"), 0).otherwise(1)).over(
                order.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .groupBy("row", "group")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", F.negative("end"), "kind")).alias("kind"))
    )
    before = F.coalesce(
        F.lag("end").over(Window.partitionBy("row").orderBy("start")), F.lit(0)
    )
    cuts = (
        merged.withColumn("before", before)
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "before", "kind"))).alias("cuts"))
        .join(proposed.select("row", "doc_id", "text_hash"), "row")
        .groupBy("doc_id", "text_hash")
        .agg(F.first("cuts").alias("cuts"))
        .select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "cuts")
    )
    cuts = tables.stored(cuts, "cuts")
    names = [f"_{i}" for i in range(len(docs.columns))]
    doc, text = (F.col(f"_{docs.columns.index(c)}") for c in (id_col, text_col))
    joined = docs.toDF(*names).join(
        tables.small(cuts, cuts.count()),
        doc.cast("bigint").eqNullSafe(F.col("_doc"))
        & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_hash")),
        "left",
    )
    parts = F.transform(
        "cuts",
        lambda c: F.concat(
            F.substring(text, c["before"] + 1, c["start"] - c["before"]),
            F.lit("["), F.upper(c["kind"]), F.lit("]"),
        ),
    )
    last = F.element_at(F.col("cuts.end"), -1)
    clean = F.when(
        F.col("cuts").isNotNull(),
        F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text))),
    ).otherwise(text)
    place = docs.columns.index(text_col)
    return joined.select(
        *[clean.alias(n) if i == place else F.col(n) for i, n in enumerate(names)]
    ).toDF(*docs.columns)
