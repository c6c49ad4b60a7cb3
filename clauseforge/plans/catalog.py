"""Every operator as a named query over whole tables: ``fn(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.functions import encode
from clauseforge.functions.formula import formula_column
from clauseforge.functions.masks import bit_string
from clauseforge.functions.predicates import literal_matches, literal_misses, term_allows
from clauseforge.operators import evaluate
from clauseforge.operators import histograms as hist
from clauseforge.operators import instances as inst
from clauseforge.operators import relevance as rel
from clauseforge.operators.rows import covered_rows as rows_covered
from clauseforge.operators.rows import erased_rows as rows_erased
from clauseforge.plans.fixtures import (
    DOCUMENT_WIDTH,
    LINE_WIDTH,
    PART_WIDTH,
    WORD_WIDTH,
    document_instances,
    judged_document_instances,
    lineitem_instances,
    order_dates,
    part_features,
    part_instances,
    table,
    uncertain_part_instances,
    widened,
    word_shape_instances,
)
from clauseforge.plans.job import train_job
from clauseforge.plans.learner import fit, fit_labelled, learn_term
from clauseforge.plans.model import RuleModel, load_model
from clauseforge.sources import sequences
from clauseforge.sources.model_store import parse_rows
from clauseforge.storage import fresh_path
from clauseforge.streaming import flows

# The literal "p_type is PROMO", its negation's partner "p_size % 5 is
# not 1", and the term both make.
PROMO = 3
NOT_ONE = PART_WIDTH + 7
PROMO_TERM = {3: 1, 7: 0}
# A model that is wrong on a known part of the parts: it wants no size of the economy ones.
ROUGH_TERMS = [PROMO_TERM, {0: 1}]
# 2,400 terms: a type, a size and two words of the name.
MANY_TERMS = [
    {t: 1, 6 + r: 1, 11 + w: 1, 11 + v: 1}
    for t in range(6) for r in range(5) for v in range(16) for w in range(v) if (t + 2 * r + w + 3 * v) % 3
]
# So few vectors to a block that both sides of the part table need several.
BLOCK_BYTES = 17 * 128
LETTERS = "aetn"
DIGITS = "0123456789"


def _model(spark: SparkSession, sf_dir: str) -> RuleModel:
    return fit_labelled(part_instances(spark, sf_dir), width=PART_WIDTH)


def _gathered(df: DataFrame, width: int = PART_WIDTH, on_conflict: str = "error") -> inst.Instances:
    """Instances for one lazy query: written once, not held in memory."""
    return inst.gather_instances(df, on_conflict=on_conflict, cache=False, width=width)


def _text(df: DataFrame, *decimals: str) -> DataFrame:
    """Exact sums as strings, so that no reader rounds them."""
    for name in decimals:
        df = df.withColumn(name, F.col(name).cast("string"))
    return df


# Rows and labels


def split_counts(spark, sf_dir):
    inst.register_sides(part_instances(spark, sf_dir), "part_positive", "part_negative")
    return spark.sql(
        "SELECT 1 AS label, count(*) AS rows FROM part_positive "
        "UNION ALL SELECT 0 AS label, count(*) AS rows FROM part_negative"
    )


def empty_sides(spark, sf_dir):
    """Both sides of the parts, and of those parts that the known rule leaves no positive."""
    df = part_instances(spark, sf_dir)
    covered = term_allows(F.col("features"), PROMO_TERM) | literal_matches(F.col("features"), 0, PART_WIDTH)
    out = [
        inst.side_emptiness(rows).select(F.lit(name).alias("rows"), "label", "empty")
        for name, rows in (("all", df), ("uncovered", df.where(~covered)))
    ]
    return out[0].unionByName(out[1])


def literal_match(spark, sf_dir):
    df = part_instances(spark, sf_dir)
    return df.filter(literal_matches(F.col("features"), PROMO, PART_WIDTH)).select("id", "label")


def literal_miss(spark, sf_dir):
    df = part_instances(spark, sf_dir)
    return df.filter(literal_misses(F.col("features"), PROMO, PART_WIDTH)).select("id", "label")


def split_flags(spark, sf_dir):
    df = part_instances(spark, sf_dir)
    kept = literal_matches(F.col("features"), NOT_ONE, PART_WIDTH)
    return df.select("id", "label", kept.cast("int").alias("kept"))


def uncovered_positives(spark, sf_dir):
    positive = part_instances(spark, sf_dir).filter(F.col("label") == 1)
    return positive.filter(~term_allows(F.col("features"), PROMO_TERM)).select("id")


# Encoders and vectors


def _whole_texts(spark, sf_dir) -> DataFrame:
    return widened(table(spark, sf_dir, "documents").select("text"))


def onehot_sum(spark, sf_dir):
    active = encode.one_hot_active(F.col("text"), LETTERS)
    hot = _whole_texts(spark, sf_dir).select(F.explode(active).alias("feature"))
    size = len(LETTERS)
    return hot.groupBy("feature").agg(F.count(F.lit(1)).alias("rows")).select(
        F.expr(f"feature div {size}").cast("int").alias("position"),
        (F.col("feature") % size).cast("int").alias("code"),
        "rows",
    )


def index_encode(spark, sf_dir):
    codes = encode.index_code(F.col("text"), LETTERS)
    return (
        _whole_texts(spark, sf_dir)
        .select(F.posexplode(codes).alias("position", "code"))
        .groupBy("position", F.col("code").cast("int").alias("code"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def vector_roundtrip(spark, sf_dir):
    part = part_features(table(spark, sf_dir, "part"))
    lines = part.select(
        F.col("p_partkey").alias("id"),
        F.array_join(F.col("features").cast("array<string>"), ",").alias("value"),
    )
    parsed = lines.select("id", F.split("value", ",").cast("array<double>").alias("features"))
    arrays = encode.to_arrays(encode.to_vectors(parsed))
    return arrays.select("id", F.posexplode("features").alias("feature", "value"))


def assembled_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice"
    )
    both = encode.to_arrays(encode.assemble(part, ["p_size", "p_retailprice"]))
    return both.select("id", F.posexplode("features").alias("feature", "value"))


def text_source(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(
        (F.col("lang") == "en").cast("int").alias("english"), F.translate("text", "\r\n", "  ").alias("value")
    )
    paths = {}
    for value in (1, 0):
        paths[value] = fresh_path(spark, f"sequences-{value}")
        lines.filter(F.col("english") == value).select("value").write.text(paths[value])
    read = sequences.read_labelled_sequences(spark, paths[1], paths[0])
    return read.groupBy("label", "seq").agg(F.count(F.lit(1)).alias("rows"))


# Pairs and relevance


def pair_distance(spark, sf_dir):
    return _text(rel.pair_distances(_gathered(part_instances(spark, sf_dir))), "pairs")


def pair_distance_documents(spark, sf_dir):
    return _text(rel.pair_distances(_gathered(document_instances(spark, sf_dir), DOCUMENT_WIDTH)), "pairs")


def pair_distance_uncertain(spark, sf_dir):
    return _text(rel.pair_distances(_gathered(uncertain_part_instances(spark, sf_dir))), "pairs")


def pair_distance_words(spark, sf_dir):
    return _text(rel.pair_distances(_gathered(word_shape_instances(spark, sf_dir), WORD_WIDTH)), "pairs")


def pair_distance_lineitem(spark, sf_dir):
    return _text(rel.pair_distances(_gathered(lineitem_instances(spark, sf_dir), LINE_WIDTH)), "pairs")


def pair_semi(spark, sf_dir):
    df = part_instances(spark, sf_dir)
    survivors = df.filter(literal_matches(F.col("features"), PROMO, PART_WIDTH)).select("id")
    left = df.join(survivors, "id", "left_semi")
    return _text(rel.pair_distances(_gathered(left)), "pairs")


def pair_semi_uncovered(spark, sf_dir):
    df = part_instances(spark, sf_dir)
    left_over = (F.col("label") == 0) | ~term_allows(F.col("features"), PROMO_TERM)
    left = df.join(df.filter(left_over).select("id"), "id", "left_semi")
    return _text(rel.pair_distances(_gathered(left)), "pairs")


def pair_semi_histograms(spark, sf_dir):
    """Pairs among the survivors of a literal, from the stored histograms of all vectors."""
    stored = hist.distance_histograms(_gathered(part_instances(spark, sf_dir)))
    return _text(hist.distances_meeting(stored, {NOT_ONE - PART_WIDTH: 0}), "pairs")


def pair_semi_uncovered_histograms(spark, sf_dir):
    stored = hist.distance_histograms(_gathered(part_instances(spark, sf_dir)))
    return _text(hist.distances_uncovered(stored, PROMO_TERM), "pairs")


def _relevance(
    strategy: str, instances=part_instances, width: int = PART_WIDTH, halves: str = "weighted", **options
):
    def query(spark, sf_dir):
        gathered = _gathered(instances(spark, sf_dir), width)
        return _text(rel.relevance(gathered, strategy=strategy, halves=halves, **options), "r")

    return query


def relevance_documents_drop(spark, sf_dir):
    gathered = _gathered(judged_document_instances(spark, sf_dir), DOCUMENT_WIDTH, "drop")
    return _text(rel.relevance(gathered), "r")


def top_literal(spark, sf_dir):
    gathered = _gathered(part_instances(spark, sf_dir))
    return _text(rel.top_literal(rel.relevance(gathered)), "r")


def survivor_counts(spark, sf_dir):
    return rel.survivor_counts(_gathered(part_instances(spark, sf_dir)), {PROMO: 1})


def relevance_update(spark, sf_dir):
    gathered = _gathered(part_instances(spark, sf_dir))
    before = rel.relevance(gathered)
    return _text(rel.relevance_after(gathered, before, PROMO), "r")


def relevance_update_uncertain(spark, sf_dir):
    gathered = _gathered(uncertain_part_instances(spark, sf_dir))
    before = rel.relevance(gathered, halves="distance")
    return _text(rel.relevance_after(gathered, before, PROMO, halves="distance"), "r")


# Rows behind the rules


def covered_rows(spark, sf_dir):
    model = _model(spark, sf_dir)
    positive = part_instances(spark, sf_dir).where("label = 1")
    return rows_covered(positive, model.terms, PART_WIDTH, keep=["id"], digests=True)


def erased_rows(spark, sf_dir):
    df = part_instances(spark, sf_dir)
    first = learn_term(df, width=PART_WIDTH).orderBy("step").select("lit").collect()
    return rows_erased(df, [r["lit"] for r in first], PART_WIDTH, keep=["id"], digests=True)


def relevance_update_weighted(spark, sf_dir):
    gathered = _gathered(uncertain_part_instances(spark, sf_dir))
    before = rel.relevance_coefficients(gathered)
    return _text(rel.relevance_after(gathered, before, NOT_ONE), "r")


def relevance_coefficients(spark, sf_dir):
    gathered = _gathered(uncertain_part_instances(spark, sf_dir))
    return _text(rel.relevance_coefficients(gathered, "cross"), "full", "part")


# Learning


def first_term_trace(spark, sf_dir):
    trace = learn_term(part_instances(spark, sf_dir), width=PART_WIDTH)
    return _text(trace.select("step", "lit", "r", "p", "q"), "r")


def first_term_trace_documents(spark, sf_dir):
    trace = learn_term(document_instances(spark, sf_dir), width=DOCUMENT_WIDTH)
    return _text(trace.select("step", "lit", "r", "p", "q"), "r")


def learned_terms(spark, sf_dir):
    return _model(spark, sf_dir).terms_table(spark)


def learned_terms_documents(spark, sf_dir):
    model = fit_labelled(document_instances(spark, sf_dir), width=DOCUMENT_WIDTH)
    return model.terms_table(spark)


def learned_terms_uncertain(spark, sf_dir):
    model = fit_labelled(uncertain_part_instances(spark, sf_dir), width=PART_WIDTH)
    return model.terms_table(spark)


def fit_two_sets(spark, sf_dir):
    """Two vector tables, as a user has them."""
    vectors = encode.to_vectors(part_instances(spark, sf_dir))
    positive, negative = inst.split_by_label(vectors)
    return fit(positive, negative).terms_table(spark)


def formula_terms(spark, sf_dir):
    return formula_column(_model(spark, sf_dir).terms_table(spark))


def _learned(strategy: str, **options):
    def query(spark, sf_dir):
        df = part_instances(spark, sf_dir)
        return fit_labelled(df, strategy=strategy, width=PART_WIDTH, **options).terms_table(spark)

    return query


def model_metadata(spark, sf_dir):
    meta = _model(spark, sf_dir).metadata_table(spark)
    return meta.select("formula", "training_pos", "training_neg", "width", "term_count")


def conflicting_vectors(spark, sf_dir):
    distinct = inst.distinct_vectors(judged_document_instances(spark, sf_dir), DOCUMENT_WIDTH)
    return inst.conflicting_vectors(distinct).select(
        bit_string(DOCUMENT_WIDTH).alias("vector"), (F.col("pos") + F.col("neg")).alias("rows")
    )


# Classification and evaluation


def classify(spark, sf_dir):
    classified = _model(spark, sf_dir).transform(part_instances(spark, sf_dir))
    return classified.select("id", "class")


def sequence_rules(spark, sf_dir):
    width = 10 * len(DIGITS)
    hot = encode.one_hot_set(F.col("seq"), width, DIGITS)
    encoded = order_dates(spark, sf_dir).withColumn("features", hot)
    return fit_labelled(encoded, width=width).transform(encoded).select("id", "class")


def classify_reloaded(spark, sf_dir):
    train_path, model_path = fresh_path(spark, "train"), fresh_path(spark, "rules")
    df = part_instances(spark, sf_dir)
    df.write.parquet(train_path)
    train_job(spark, train_path, model_path)
    return load_model(spark, model_path).transform(df).select("id", "class")


def train_job_partitions(spark, sf_dir):
    train_path, model_path = fresh_path(spark, "train"), fresh_path(spark, "rules")
    part_instances(spark, sf_dir).write.parquet(train_path)
    train_job(spark, train_path, model_path, 2, 5)
    return load_model(spark, model_path).terms_table(spark)


def classify_many_terms(spark, sf_dir):
    model = RuleModel(MANY_TERMS, PART_WIDTH)
    return model.transform(part_instances(spark, sf_dir)).select("id", "class")


def classify_held_out(spark, sf_dir):
    df = part_instances(spark, sf_dir)
    model = fit_labelled(df.where(F.col("id") % 5 != 0), width=PART_WIDTH)
    return model.transform(df.where(F.col("id") % 5 == 0)).select("id", "label", "class")


def classify_csv_model(spark, sf_dir):
    path = fresh_path(spark, "rules")
    _model(spark, sf_dir).save(spark, path, fmt="csv")
    return load_model(spark, path, fmt="csv").transform(part_instances(spark, sf_dir)).select("id", "class")


def saved_term_rows(spark, sf_dir):
    path = fresh_path(spark, "rules")
    _model(spark, sf_dir).save(spark, path, fmt="csv")
    rows = parse_rows(spark.read.text(f"{path}.model"))
    numbers = rows.select(F.posexplode("features").alias("feature", "value"))
    return numbers.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("terms"))


def _second_label(spark, sf_dir) -> DataFrame:
    """The parts with a label that neither the rough model nor the known rule gets all right."""
    dear = F.col("label") + (F.col("id") % 7 == 0).cast("int")
    return part_instances(spark, sf_dir).withColumn("label", dear % 2)


def confusion(spark, sf_dir):
    model = RuleModel(ROUGH_TERMS, PART_WIDTH)
    return evaluate.confusion(model.transform(_second_label(spark, sf_dir)))


def accuracy(spark, sf_dir):
    model = RuleModel(ROUGH_TERMS, PART_WIDTH)
    found = evaluate.accuracy(model.transform(_second_label(spark, sf_dir)))
    return found.select("hits", "rows", F.floor(F.col("accuracy") * 1000000).alias("per_million"))


# Streams


def _stream_counts(column: str):
    def query(spark, sf_dir):
        path, out = fresh_path(spark, "event-csv"), fresh_path(spark, "stream-counts")
        keys = table(spark, sf_dir, "events").select(F.col(column).cast("string").alias("seq"))
        keys.write.csv(path, header=True)
        stream = sequences.stream_csv(spark, path, sequences.csv_schema(spark, path), files_per_trigger=4)
        state = fresh_path(spark, "stream-state")
        flows.to_keyed(flows.counts(stream), out, state, once=True).awaitTermination()
        counted = flows.read_keyed(spark, out)
        return counted.select(F.col("seq").cast("string").alias("seq"), F.col("count").alias("rows"))

    return query


def stream_merged_counts(spark, sf_dir):
    """As many batches as the events have files, merged every three batches."""
    path, out = fresh_path(spark, "event-csv"), fresh_path(spark, "stream-counts")
    keys = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("seq"))
    keys.repartition(10).write.csv(path, header=True)
    stream = sequences.stream_csv(spark, path, sequences.csv_schema(spark, path), files_per_trigger=1)
    state = fresh_path(spark, "stream-state")
    flows.to_keyed(flows.counts(stream), out, state, once=True, merge_after=3).awaitTermination()
    counted = flows.read_keyed(spark, out)
    return counted.select(F.col("seq").cast("string").alias("seq"), F.col("count").alias("rows"))


def stream_complete_counts(spark, sf_dir):
    """The complete result of few keys, kept as a table by the stream."""
    path, name = fresh_path(spark, "event-csv"), f"event_counts_{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select(F.col("event_type").alias("seq")).write.csv(path, header=True)
    stream = sequences.stream_csv(spark, path, sequences.csv_schema(spark, path), files_per_trigger=2)
    flows.to_memory(flows.counts(stream), name, fresh_path(spark, "stream-state"), once=True).awaitTermination()
    return spark.table(name).select("seq", F.col("count").alias("rows"))


def stream_classify(spark, sf_dir):
    model = _model(spark, sf_dir)
    schema = table(spark, sf_dir, "part").schema
    stream = part_features(sequences.stream_parquet(spark, sf_dir, schema, "part.parquet"))
    classified = flows.classify(stream, model).select(F.col("p_partkey").alias("id"), "class")
    out = fresh_path(spark, "stream-classified")
    flows.to_parquet(classified, out, fresh_path(spark, "stream-state"), once=True).awaitTermination()
    return spark.read.schema(classified.schema).parquet(out)


QUERIES = {
    "split_counts": split_counts,
    "empty_sides": empty_sides,
    "literal_match": literal_match,
    "literal_miss": literal_miss,
    "split_flags": split_flags,
    "uncovered_positives": uncovered_positives,
    "onehot_sum": onehot_sum,
    "index_encode": index_encode,
    "vector_roundtrip": vector_roundtrip,
    "assembled_columns": assembled_columns,
    "text_source": text_source,
    "pair_distance": pair_distance,
    "pair_distance_documents": pair_distance_documents,
    "pair_distance_uncertain": pair_distance_uncertain,
    "pair_distance_lineitem": pair_distance_lineitem,
    "pair_distance_words": pair_distance_words,
    "pair_semi": pair_semi,
    "pair_semi_uncovered": pair_semi_uncovered,
    "pair_semi_histograms": pair_semi_histograms,
    "pair_semi_uncovered_histograms": pair_semi_uncovered_histograms,
    "relevance_vector": _relevance("auto"),
    "relevance_broadcast_positive": _relevance("broadcast_positive"),
    "relevance_broadcast_negative": _relevance("broadcast_negative"),
    "relevance_grid": _relevance("cross", limit=BLOCK_BYTES),
    "relevance_documents": _relevance("auto", document_instances, DOCUMENT_WIDTH),
    "relevance_documents_drop": relevance_documents_drop,
    "relevance_words": _relevance("auto", word_shape_instances, WORD_WIDTH),
    "relevance_lineitem": _relevance("auto", lineitem_instances, LINE_WIDTH),
    "relevance_uncertain": _relevance("broadcast_positive", uncertain_part_instances),
    "relevance_uncertain_distance": _relevance("cross", uncertain_part_instances, halves="distance"),
    "top_literal": top_literal,
    "survivor_counts": survivor_counts,
    "relevance_update": relevance_update,
    "relevance_update_uncertain": relevance_update_uncertain,
    "relevance_update_weighted": relevance_update_weighted,
    "relevance_coefficients": relevance_coefficients,
    "covered_rows": covered_rows,
    "erased_rows": erased_rows,
    "first_term_trace": first_term_trace,
    "first_term_trace_documents": first_term_trace_documents,
    "learned_terms": learned_terms,
    "learned_terms_broadcast_negative": _learned("broadcast_negative"),
    "learned_terms_grid": _learned("cross", limit=BLOCK_BYTES),
    "learned_terms_uncertain": learned_terms_uncertain,
    "fit_two_sets": fit_two_sets,
    "learned_terms_documents": learned_terms_documents,
    "formula_terms": formula_terms,
    "model_metadata": model_metadata,
    "conflicting_vectors": conflicting_vectors,
    "classify": classify,
    "sequence_rules": sequence_rules,
    "classify_reloaded": classify_reloaded,
    "train_job_partitions": train_job_partitions,
    "classify_many_terms": classify_many_terms,
    "classify_held_out": classify_held_out,
    "classify_csv_model": classify_csv_model,
    "saved_term_rows": saved_term_rows,
    "confusion": confusion,
    "accuracy": accuracy,
    "stream_counts": _stream_counts("event_type"),
    "stream_user_counts": _stream_counts("user_id"),
    "stream_merged_counts": stream_merged_counts,
    "stream_complete_counts": stream_complete_counts,
    "stream_classify": stream_classify,
}
