"""Row keys, sparse features and the index of terms."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from tables import instances

from clauseforge import RuleModel, fit_labelled
from clauseforge.functions.encode import encode, feature_set, one_hot_set, to_vectors
from clauseforge.operators.instances import gather_instances, pack
from clauseforge.operators.relevance import relevance
from clauseforge.operators.rows import covered_rows, erased_rows, keyed_rows
from clauseforge.plans import model as model_module

TERMS = [{0: 1, 4: 0}, {2: 1}]


def random_instances(spark, values=(0, 1), rows=60, width=6, seed=1):
    rng = np.random.default_rng(seed)
    found = rng.choice(values, size=(rows, width)).tolist()
    return instances(spark, found[: rows // 2], found[rows // 2 :])


def first_term(row, terms):
    for no, term in enumerate(terms, start=1):
        if all(row[k] != 1 - want for k, want in term.items()):
            return no
    return None


def test_places_stay_under_any_partitioning(spark, tmp_path):
    path = str(tmp_path / "rows")
    random_instances(spark, rows=400).repartition(5).write.parquet(path)
    read = spark.read.parquet(path)
    want = None
    for split in ("64m", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            for df in (spark.read.parquet(path), spark.read.parquet(path).where("id >= 0").select("features", "id")):
                got = sorted(map(tuple, covered_rows(df, TERMS, 6, keep=["id"]).collect()))
                want = want or got
                assert got == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    keys = [k for _, k, _ in want]
    assert len(set(keys)) == len(keys) and all("#" in k for k in keys)
    rows = {r["id"]: r["features"] for r in read.collect()}
    assert {i: no for i, _, no in want} == {
        i: first_term(x, TERMS) for i, x in rows.items() if first_term(x, TERMS)
    }


@pytest.mark.parametrize("values", [(0, 1), (0, 0.5, 1)])
def test_digests_name_equal_rows(spark, values):
    df = random_instances(spark, values)
    rows = {r["id"]: r["features"] for r in df.collect()}
    keyed = {r["id"]: r["row_key"] for r in keyed_rows(df.repartition(7), 6, keep=["id"]).collect()}
    for i, x in rows.items():
        text = "".join(str(int(v == 1)) for v in x)
        if 0.5 in x:
            text += ":" + "".join(str(int(v == 0.5)) for v in x)
        assert keyed[i] == hashlib.sha256(text.encode()).hexdigest()
    erased = {r["id"]: (r["step"], r["row_key"]) for r in erased_rows(df, [0, 10], 6, keep=["id"]).collect()}
    assert erased == {
        i: (1 if x[0] != 1 else 2, keyed[i]) for i, x in rows.items() if x[0] != 1 or x[4] != 0
    }


def test_covered_rows_are_those_training_takes_away(spark):
    df = instances(spark, [(1, 0), (1, 0), (0, 1)], [(0, 0), (1, 1)])
    model = fit_labelled(df)
    got = covered_rows(df.where("label = 1"), model.terms, 2, keep=["id"]).select("id", "term_no").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1, 1), (2, 2)]
    assert covered_rows(df.limit(0), model.terms, 2).count() == 0 and covered_rows(df, [], 2).count() == 0


def packed(df, width):
    return sorted(map(tuple, pack(df, width, keep=["id"]).collect()))


@pytest.mark.parametrize("width, values", [(3, (0, 1)), (64, (0, 0.5, 1)), (200, (0, 0, 0, 0, 0.5, 1))])
def test_arrays_vectors_and_sets_pack_alike(spark, width, values):
    rng = np.random.default_rng(width)
    rows = rng.choice(values, size=(50, width)).tolist() + [[0.0] * width, [1.0] * width]
    arrays = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id int, features array<double>")
    wanted = packed(arrays, width)
    mixed = [
        (i, Vectors.dense(r) if i % 3 == 0 else Vectors.sparse(width, {k: x for k, x in enumerate(r) if x or i % 5 == 0}))
        for i, r in enumerate(rows)
    ]
    assert packed(spark.createDataFrame(mixed, ["id", "features"]), width) == wanted
    assert packed(to_vectors(arrays), width) == wanted
    if 0.5 not in values:
        held = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.get("features", k) == 1.0)
        sets = arrays.withColumn("features", feature_set(F.concat(F.reverse(held), held), width))
        assert packed(sets, width) == wanted


def test_sparse_rows_are_checked(spark):
    bad = [(5, {1: 1.0}), (4, {1: 0.7}), (4, {2: 2.0})]
    for size, entries in bad:
        df = spark.createDataFrame([(0, Vectors.sparse(size, entries))], ["id", "features"])
        with pytest.raises(Exception, match="is not 4 values of 0, 0.5 or 1"):
            pack(df, 4).collect()
    for indices in ("array(4)", "array(-1)", "array(1, cast(null AS int))", "cast(null AS array<int>)"):
        df = spark.range(1).select(feature_set(F.expr(indices), 4).alias("features"))
        for action in (lambda df: pack(df, 4), RuleModel([{1: 1}], 4).transform):
            with pytest.raises(Exception, match="is not 4 values of 0, 0.5 or 1"):
                action(df).collect()


def test_no_row_becomes_an_array_of_doubles(spark):
    width = 5000
    rows = [(i, int(i % 2), Vectors.sparse(width, {i % 7: 1.0, 4000 + i % 3: 1.0})) for i in range(40)]
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    gathered = gather_instances(df, width=width)
    plan = pack(df, width)._jdf.queryExecution().toString()
    assert "vector_to_array" not in plan.lower() and "UDF" not in plan
    sums = {r["lit"]: int(r["r"]) for r in relevance(gathered).collect()}
    assert len(sums) == 2 * width and sums[10] == 0
    model = fit_labelled(df.withColumn("label", (F.col("id") % 7 == 3).cast("int")), width=width)
    assert model.terms == [{3: 1}]


def test_sets_learn_and_classify_like_arrays(spark):
    reads = [("".join(r), i) for i, r in enumerate(np.random.default_rng(2).choice(list("ACGTN"), (80, 6)))]
    df = spark.createDataFrame(reads, "seq string, id int").withColumn("label", F.col("seq").substr(2, 1).isin("A", "G").cast("int"))
    as_sets = df.withColumn("features", one_hot_set(F.col("seq"), 24))
    as_arrays = encode(df, "seq")
    models = [fit_labelled(x) for x in (as_sets, as_arrays)]
    assert models[0] == models[1] or models[0].terms == models[1].terms
    classes = [
        sorted((r["id"], r["class"]) for r in models[0].transform(x).collect()) for x in (as_sets, as_arrays)
    ]
    assert classes[0] == classes[1]


def test_index_of_terms_finds_what_all_terms_find(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = random_instances(spark, (0, 0, 0.5, 1), rows=120, width=70)
    terms = [
        {int(k): int(rng.integers(0, 2)) for k in rng.choice(70, size=rng.integers(1, 7), replace=False)}
        for _ in range(300)
    ]
    rows = df.collect()
    for some in (terms[:40], [t for t in terms if not any(t.values())][:5], [t for t in terms if len(t) > 4]):
        model = RuleModel(some, 70)
        held = [t for bucket in model.term_index() for t in bucket]
        assert len(held) == len(some)
        monkeypatch.setattr(model_module, "INLINE_LITERALS", 0)
        got = {r["id"]: r["class"] for r in model.transform(df).collect()}
        assert got == {r["id"]: float(first_term(r["features"], some) is not None) for r in rows}


def test_few_terms_stand_under_a_feature():
    terms = [{t: 1, 10 + w: 1} for t in range(4) for w in range(50)] + [{3: 0}]
    index = RuleModel(terms, 60).term_index()
    assert sum(map(len, index)) == 201 and len(index[60]) == 1
    # Under their words and not under their four types.
    assert max(map(len, index[:60])) <= 8
