import numpy as np
import pytest
from brute import learn
from pyspark.sql import functions as F
from tables import TESTDATA, heads160, instances

from clauseforge import (
    EmptySideError,
    InconsistentDataError,
    NoProgressError,
    fit,
    fit_labelled,
    learn_term,
    storage,
)
from clauseforge.functions.encode import encode, to_vectors
from clauseforge.operators import pairs
from clauseforge.operators.evaluate import accuracy
from clauseforge.operators.instances import gather_instances, split_by_label
from clauseforge.operators.pairs import BLOCK_ROWS, choose_strategy, grid_of
from clauseforge.operators.relevance import relevance, relevance_after, top_literal
from clauseforge.plans import learner
from clauseforge.plans.fixtures import judged_document_instances, part_instances
from clauseforge.sources.sequences import read_labelled_sequences

STRATEGIES = ["auto", "broadcast_positive", "broadcast_negative", "cross"]
UNIT = 2**36


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_two_bit_parity(spark, strategy):
    df = instances(spark, [(1, 0), (0, 1)], [(0, 0), (1, 1)])
    model = fit_labelled(df, strategy=strategy)
    assert model.formula == "x1x2^ + x1^x2"
    assert [s.lit for s in model.trace] == [0, 3, 1, 2]


def test_fit_takes_two_sets(spark):
    positive, negative = split_by_label(instances(spark, [(1, 0), (0, 1)], [(0, 0), (1, 1)]))
    model = fit(positive, negative, verbose=True, use_cache=False)
    assert (model.formula, model.training_pos, model.training_neg) == ("x1x2^ + x1^x2", 2, 2)


@pytest.mark.parametrize(
    "sf, steps",
    [
        ("0.001", [(3, 620), (34, 59.41667), (6, 184.54167), (0, 35.91667)]),
        ("0.01", [(3, 63356.75), (34, 3141.83333), (0, 14047.75), (6, 3130.16667)]),
    ],
)
def test_known_part_rule(spark, sf, steps):
    model = fit_labelled(part_instances(spark, f"{TESTDATA}/sf{sf}"))
    assert model.formula == "x4x8^ + x1x7"
    assert [s.lit for s in model.trace] == [lit for lit, _ in steps]
    assert [s.r / UNIT for s in model.trace] == pytest.approx([r for _, r in steps], rel=1e-6)


def test_many_ties(spark):
    df = heads160(spark, "0.001", "toxic")
    wanted = "x16^x28^x48x58^ + x80^x83 + x8x13^x88^x144 + x64x84 + x1x29 + x6x136"
    for strategy in ("auto", "cross"):
        model = fit_labelled(df, strategy=strategy)
        assert (model.formula, len(model.trace)) == (wanted, 16)


def test_carrying_forward_changes_nothing(spark):
    df = heads160(spark, "0.01", "quality")
    carried = fit_labelled(df, on_conflict="drop", max_terms=4)
    direct = fit_labelled(df.repartition(3), on_conflict="drop", max_terms=4, carry=False)
    assert any(s.carried for s in carried.trace) and not any(s.carried for s in direct.trace)
    assert [(s.lit, s.r, s.p, s.q) for s in carried.trace] == [(s.lit, s.r, s.p, s.q) for s in direct.trace]
    assert (carried.training_pos, carried.training_neg) == (299, 46)


def test_whole_formula_on_consistent_heads(spark):
    model = fit_labelled(heads160(spark, "0.01", "toxic"), on_conflict="drop")
    assert (model.training_pos, model.training_neg) == (40, 312)
    assert (len(model.terms), len(model.trace)) == (20, 61)


def test_contradictions_fail_by_name(spark):
    with pytest.raises(InconsistentDataError):
        fit_labelled(instances(spark, [(1,)], [(1,)]))
    with pytest.raises(NoProgressError):
        fit_labelled(instances(spark, [(0,)], [(0,)]))
    with pytest.raises(NoProgressError):
        fit_labelled(instances(spark, [(0,)], [(0,)]), strategy="cross")


def test_contradictions_in_heads(spark):
    with pytest.raises(InconsistentDataError, match="term 11"):
        fit_labelled(heads160(spark, "0.01", "toxic"))
    with pytest.raises(NoProgressError, match="term 14"):
        fit_labelled(heads160(spark, "0.01", "quality"))


def test_empty_sides(spark):
    df = instances(spark, [(1, 0)], [(0, 0)])
    for label in (0, 1):
        with pytest.raises(EmptySideError):
            fit_labelled(df.filter(F.col("label") == label))
    positive, negative = split_by_label(df)
    with pytest.raises(EmptySideError, match="negative"):
        fit(positive, negative.limit(0))


def test_unequal_widths_and_odd_values(spark):
    for bad in ([1.0], [1.0, 2.0], [1.0, None]):
        rows = [(1, [1.0, 0.0]), (0, [0.0, 0.0]), (0, bad)]
        df = spark.createDataFrame(rows, "label int, features array<double>")
        with pytest.raises(Exception, match="feature vector is not"):
            fit_labelled(df)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = {tuple(r) for r in rng.integers(0, 2, size=(60, 7)).tolist()}
    rows = sorted(rows)
    pos = [r for r in rows if r[0] and r[3] or r[5] and not r[6]]
    neg = [r for r in rows if r not in pos]
    pos, neg = pos + pos[:3], neg + neg[:2]
    wanted = learn(pos, neg)
    for strategy, partitions in (("auto", 1), ("broadcast_negative", 5), ("cross", 3)):
        model = fit_labelled(instances(spark, pos, neg, partitions), strategy=strategy)
        assert model.terms == wanted
        classified = model.transform(instances(spark, pos, neg))
        assert classified.filter(F.col("class") != F.col("label")).count() == 0


def test_uncertain_values(spark):
    one = fit_labelled(instances(spark, [(1, 0.5)], [(0, 0)]))
    assert one.formula == "x1"
    assert one.trace[0].r / 2.0 ** one.trace[0].unit_bits == pytest.approx(0.8)
    both = instances(spark, [(0.5, 0.5)], [(0, 0.5)])
    gathered = gather_instances(both)
    rows = {r["lit"]: float(r["r"]) / 2.0**90 for r in relevance(gathered).collect()}
    assert rows == {0: 0.5, 1: 0.25, 2: 0.0, 3: 0.25}
    assert fit_labelled(both).formula == "x1"


def test_uncertain_values_random(spark):
    rng = np.random.default_rng(11)
    pos = rng.choice([0, 0.5, 1], size=(12, 6)).tolist()
    neg = [r for r in rng.choice([0, 0.5, 1], size=(60, 6)).tolist() if r not in pos]
    wanted = learn(pos, neg)
    for strategy in ("broadcast_positive", "cross"):
        df = instances(spark, pos, neg)
        if wanted is None:
            with pytest.raises((InconsistentDataError, NoProgressError)):
                fit_labelled(df, strategy=strategy, halves="weighted")
        else:
            assert fit_labelled(df, strategy=strategy, halves="weighted").terms == wanted


def test_one_vector_holds_a_third_of_the_rows(spark):
    rng = np.random.default_rng(7)
    pos = rng.integers(0, 2, size=(40, 8)).tolist()
    pos = [[1] + r[1:] for r in pos] + [[1] * 8] * 40
    neg = [[0] + r[1:] for r in rng.integers(0, 2, size=(60, 8)).tolist()] + [[0] * 8] * 60
    df = instances(spark, pos, neg)
    results = [fit_labelled(df, strategy=s).trace for s in ("auto", "cross")]
    assert results[0] == results[1]
    assert results[0][0].lit == 0 and (results[0][0].p, results[0][0].q) == (80, 0)


def test_relevance_carried_forward_equals_recomputed(spark):
    gathered = gather_instances(part_instances(spark, f"{TESTDATA}/sf0.001"))
    before = relevance(gathered)
    literal = top_literal(before).head()["lit"]
    again = relevance(gathered, term={literal: 1})
    for strategy in STRATEGIES:
        after = relevance_after(gathered, before, literal, strategy=strategy)
        assert sorted(after.collect()) == sorted(again.collect())


def test_top_literal_takes_the_lowest_of_a_tie(spark):
    rows = spark.createDataFrame([(5, 7), (2, 7), (3, 1)], "lit int, r int")
    assert top_literal(rows).head()["lit"] == 2


def test_vectors_and_double_labels(spark):
    df = instances(spark, [(1, 0), (0, 1)], [(0, 0), (1, 1)])
    df = to_vectors(df).withColumn("label", F.col("label").cast("double"))
    assert fit_labelled(df).formula == "x1x2^ + x1^x2"


def test_sequences_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(3)
    reads = sorted({"".join(rng.choice(list("ACGTN"), 12)) for _ in range(300)})
    wanted = {r: int(r[4:6] in ("AG", "GT")) for r in reads}
    for label in (1, 0):
        lines = [r for r in reads if wanted[r] == label]
        (tmp_path / f"{label}.txt").write_text("\r\n".join(lines) + "\r\n")
    rows = read_labelled_sequences(spark, str(tmp_path / "1.txt"), str(tmp_path / "0.txt"))
    model = fit_labelled(encode(rows, "seq"))
    assert model.width == 48
    row = accuracy(model.transform(encode(rows, "seq"))).head()
    assert (row["hits"], row["rows"], row["accuracy"]) == (len(reads), len(reads), 1.0)


def test_many_terms_with_distributed_positives(spark, monkeypatch):
    monkeypatch.setattr(learner, "TERMS_PER_CUT", 2)
    df = heads160(spark, "0.001", "toxic")
    by_negative = fit_labelled(df, strategy="broadcast_negative")
    assert [(s.lit, s.r, s.p, s.q) for s in by_negative.trace] == [
        (s.lit, s.r, s.p, s.q) for s in fit_labelled(df).trace
    ]


def test_late_steps_are_broadcast_once_they_fit(spark, monkeypatch):
    df = part_instances(spark, f"{TESTDATA}/sf0.01")
    whole = fit_labelled(df, strategy="cross")
    fetched, fetch = [], learner.array_side
    monkeypatch.setattr(learner, "array_side", lambda *a: fetched.append(1) or fetch(*a))
    limited = fit_labelled(df, limit=200 * 17)  # both sides have more distinct vectors than that
    assert limited.version.endswith("cross") and fetched
    assert [(s.lit, s.r, s.p, s.q) for s in limited.trace] == [
        (s.lit, s.r, s.p, s.q) for s in whole.trace
    ]


def test_merging_in_spark_and_on_the_driver_agree(spark, monkeypatch):
    df = part_instances(spark, f"{TESTDATA}/sf0.001")
    here = fit_labelled(df, partitions=(4, 4)).trace
    monkeypatch.setattr(pairs, "DRIVER_ROWS", 0)
    assert fit_labelled(df, partitions=(4, 4)).trace == here


def test_first_term_trace(spark):
    trace = learn_term(part_instances(spark, f"{TESTDATA}/sf0.001")).orderBy("step").collect()
    assert [(r["lit"], r["p"], r["q"]) for r in trace] == [(3, 28, 11), (34, 28, 0)]


def test_sides_past_their_limit_meet_in_a_grid(spark):
    assert choose_strategy("broadcast_positive", 1000, 10, 33, limit=1000) == "cross"
    assert choose_strategy("auto", 1000, 10, 33, limit=1000) == "broadcast_negative"
    assert choose_strategy("auto", 1000, 1000, 33, limit=1000) == "cross"
    model = fit_labelled(instances(spark, [(1, 0), (0, 1)], [(0, 0), (1, 1)]), limit=1)
    assert model.formula == "x1x2^ + x1^x2" and model.version.endswith("cross")


def test_grids_are_bounded():
    for p, q, most, cores in [
        (10_000_000, 8_000_000, 1 << 20, 800), (34_000, 34_000, 1 << 20, 8), (5, 3, 1 << 20, 8), (40, 9, 2, 8),
        (1, 10_000_000, 1 << 20, 64), (0, 7, 10, 4),
    ]:
        grid = grid_of(p, q, (most, most), 27, cores)
        assert max(grid.pos_rows, grid.neg_rows) <= min(BLOCK_ROWS, most)
        assert grid.pos_groups * grid.pos_rows >= p and grid.neg_groups * grid.neg_rows >= q
        assert 1 <= grid.tasks <= grid.pos_groups * grid.neg_groups
    # A grid of few blocks still has work for every core.
    grid = grid_of(34_000, 34_000, (1 << 20, 1 << 20), 77, 8)
    assert grid.pos_groups * grid.neg_groups >= 32


@pytest.mark.parametrize("sides", [(40, 7), (7, 40), (1, 30)])
@pytest.mark.parametrize("limit", [17, 17 * 3, 1 << 20])
def test_grids_give_the_sums_of_one_broadcast(spark, sides, limit):
    rng = np.random.default_rng(sides[0])
    pos = [[1] + r for r in rng.integers(0, 2, size=(sides[0], 9)).tolist()]
    neg = [[0] + r for r in rng.integers(0, 2, size=(sides[1], 9)).tolist()]
    gathered = gather_instances(instances(spark, pos, neg, 3))
    whole = relevance(gathered, "broadcast_positive").collect()
    assert sorted(relevance(gathered, "cross", limit=limit).collect()) == sorted(whole)
    # A term that no positive meets leaves one side without rows.
    assert all(r["r"] == 0 for r in relevance(gathered, "cross", term={0: 0}, limit=limit).collect())
    traces = [
        [(s.lit, s.r, s.p, s.q) for s in fit_labelled(instances(spark, pos, neg), strategy=s, limit=n).trace]
        for s, n in (("cross", limit), ("broadcast_positive", 1 << 20))
    ]
    assert traces[0] == traces[1]


def test_blocks_are_copied_and_rows_are_not(spark):
    gathered = gather_instances(part_instances(spark, f"{TESTDATA}/sf0.001"))
    plan = relevance(gathered, "cross", limit=17 * 4)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Cartesian" not in physical and "BroadcastNestedLoop" not in physical
    # Read from the top: every copying step stands above a packing step.
    steps = [line for line in physical.splitlines() if "Generate" in line or "MapInArrow" in line]
    assert ["Generate" in s for s in steps] == [True, False] * (len(steps) // 2) and steps


def jobs_of(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = action()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_grid_step_is_one_query_without_vectors_on_the_driver(spark, monkeypatch):
    df = part_instances(spark, f"{TESTDATA}/sf0.01")
    gathered = gather_instances(df)
    whole, _ = jobs_of(spark, "whole", lambda: sorted(relevance(gathered, "broadcast_positive").collect()))

    def fetched(*args):
        raise AssertionError("vectors were fetched")

    monkeypatch.setattr(type(df), "toArrow", fetched)
    counted = []
    for number, vectors in enumerate((4096, 64, 16)):
        rows, jobs = jobs_of(
            spark, f"grid-{number}",
            lambda: sorted(relevance(gathered, "cross", limit=gathered.row_bytes * vectors).collect()),
        )
        assert rows == whole
        counted.append(jobs)
    # From one cell to hundreds, jobs stay the same.
    assert len(set(counted)) == 1
    found = fit_labelled(df, strategy="cross", limit=gathered.row_bytes * 64)
    assert found.formula == "x4x8^ + x1x7"


def steps_of(model):
    return [(s.term_no, s.lit, s.r, s.p, s.q) for s in model.trace]


@pytest.mark.parametrize("strategy", ["broadcast_positive", "broadcast_negative"])
def test_looking_ahead_saves_jobs_and_changes_nothing(spark, monkeypatch, strategy):
    df = heads160(spark, "0.01", "toxic")
    jobs, fetch = [], learner.fetch_tally
    monkeypatch.setattr(learner, "fetch_tally", lambda *a, **k: jobs.append(1) or fetch(*a, **k))
    ahead = fit_labelled(df, on_conflict="drop", strategy=strategy)
    assert len(jobs) < 0.6 * len(ahead.trace)
    jobs.clear()
    monkeypatch.setattr(learner, "FREE_WORK", 0)
    some = fit_labelled(df, on_conflict="drop", strategy=strategy)
    monkeypatch.setattr(learner._Training, "looks_ahead", False)
    jobs.clear()
    plain = fit_labelled(df, on_conflict="drop", strategy=strategy)
    assert len(jobs) == len(plain.trace) - len([s for s in plain.trace if not s.p or not s.q]) + len(plain.terms)
    assert steps_of(ahead) == steps_of(some) == steps_of(plain) and ahead.terms == plain.terms


def test_document_fit_takes_fewer_jobs_than_literals(spark, monkeypatch):
    df = judged_document_instances(spark, f"{TESTDATA}/sf0.01")
    jobs, fetch = [], learner.fetch_tally
    monkeypatch.setattr(learner, "fetch_tally", lambda *a, **k: jobs.append(1) or fetch(*a, **k))
    model = fit_labelled(df, on_conflict="drop")
    assert len(model.trace) > 50 and len(jobs) < 0.6 * len(model.trace)


def test_looking_ahead_in_a_grid(spark):
    df = heads160(spark, "0.001", "toxic")
    wanted = steps_of(fit_labelled(df))
    assert steps_of(fit_labelled(df, strategy="cross", limit=33 * 16)) == wanted


def test_blocks_hold_every_row_once(spark):
    gathered = gather_instances(part_instances(spark, f"{TESTDATA}/sf0.001"))
    side = pairs.TableSide(gathered.side("neg"), gathered.width, False, gathered.negative_vectors, gathered.tasks)
    for rows in (1, 7, 4096):
        held = pairs.block_table(side.pick(pairs.Mask.empty(gathered.width)), rows).collect()
        assert sum(r["n"] for r in held) == gathered.negative_vectors
        assert all(r["n"] <= rows and len(r["ones"]) == 8 * r["n"] for r in held)
        assert len({r["first"] for r in held}) == len(held)


@pytest.mark.parametrize("times", [1, 12, 13, 16])
def test_uncertain_values_weigh_alike_at_every_size(spark, times):
    pos = [(1, 1, 1)] * times
    neg = ([(0, 0, 1)] * 3 + [(1, 0.5, 0)]) * times
    model = fit_labelled(instances(spark, pos, neg), strategy="broadcast_positive")
    assert model.terms == learn(pos, neg)
    assert model.formula == "x2"


def test_uncertain_values_random_above_the_threshold(spark):
    rng = np.random.default_rng(5)
    pos = rng.choice([0, 0.5, 1], size=(30, 5)).tolist()
    neg = [r for r in rng.choice([0, 0.5, 1], size=(60, 5)).tolist() if r not in pos]
    wanted = learn(pos, neg)
    for strategy in ("broadcast_positive", "broadcast_negative", "cross"):
        df = instances(spark, pos, neg)
        if wanted is None:
            with pytest.raises((InconsistentDataError, NoProgressError)):
                fit_labelled(df, strategy=strategy, halves="weighted", limit=33 * 8)
        else:
            found = fit_labelled(df, strategy=strategy, halves="weighted", limit=33 * 8)
            assert found.terms == wanted


@pytest.mark.parametrize("label", [2, None])
def test_other_labels_are_an_error(spark, label):
    df = instances(spark, [(1, 0)], [(0, 0)])
    odd = df.union(spark.createDataFrame([(9, label, [1.0, 1.0])], df.schema))
    with pytest.raises(Exception, match="is not 0 or 1"):
        fit_labelled(odd)


def test_release_deletes_what_was_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path))
    gathered = gather_instances(instances(spark, [(1, 0)], [(0, 0)]))
    assert list(tmp_path.iterdir())
    gathered.release()
    assert not list(tmp_path.iterdir())
    monkeypatch.setattr(learner, "TERMS_PER_CUT", 1)
    fit_labelled(heads160(spark, "0.001", "toxic"), strategy="broadcast_negative")
    assert not list(tmp_path.iterdir())


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())
    assert storage.is_local("local[8]") and not storage.is_local("local-cluster[2,1,1024]")


def test_stored_vectors_take_filters(spark):
    gathered = gather_instances(part_instances(spark, f"{TESTDATA}/sf0.001"), cache=False)
    plan = gathered.side("pos")._jdf.queryExecution().toString()
    assert "GreaterThan(pos,0)" in plan and "neg" not in plan.rsplit("ReadSchema", 1)[1]


def test_empty_lines_are_sequences(spark, tmp_path):
    for name, text in (("p", "ab\n\nab\n"), ("n", "\r\n")):
        (tmp_path / name).write_text(text)
    rows = read_labelled_sequences(spark, str(tmp_path / "p"), str(tmp_path / "n")).collect()
    assert sorted((r["seq"], r["label"]) for r in rows) == [("", 0), ("", 1), ("ab", 1), ("ab", 1)]
