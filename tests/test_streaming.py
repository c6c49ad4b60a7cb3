import shutil

from pyspark.sql import functions as F

from clauseforge import RuleModel
from clauseforge.functions.encode import one_hot_vector
from clauseforge.sources.sequences import csv_schema, stream_csv
from clauseforge.storage import fresh_path
from clauseforge.streaming import flows

READS = {"1.csv": ["TTCA"], "3.csv": ["TTCA", "ATCA", "GTCA", "CTCA"]}


def write(folder, name, reads):
    (folder / name).write_text("\n".join(["seq", *reads]) + "\n")


def test_keyed_counts_do_not_pass_through_the_driver(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part, n in enumerate((3, 5)):
        rows = spark.range(n).selectExpr("concat('k', id) AS seq").coalesce(1)
        rows.write.mode("append").csv(source, header=True)
        stream = stream_csv(spark, source, csv_schema(spark, source), files_per_trigger=1)
        flows.to_keyed(flows.counts(stream), out, state, once=True).awaitTermination()
    found = {r["seq"]: r["count"] for r in flows.read_keyed(spark, out).collect()}
    assert found == {"k0": 2, "k1": 2, "k2": 2, "k3": 1, "k4": 1}


def batch(spark, path, number, counts):
    rows = spark.createDataFrame(list(counts.items()), "seq string, count bigint")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")


def keyed(spark, path):
    return {r["seq"]: r["count"] for r in flows.read_keyed(spark, path).collect()}


def test_merged_files_stay_bounded_and_lose_nothing(spark, tmp_path):
    path, wanted = str(tmp_path), {}
    most = 0
    for number in range(50):
        changed = {f"k{number % 7}": number + 1, f"once{number}": 1}
        wanted |= changed
        batch(spark, path, number, changed)
        flows.merge_batches(spark, path, merge_after=5)
        most = max(most, len(list(tmp_path.iterdir())))
        if number in (3, 4, 22, 49):
            assert keyed(spark, path) == wanted
    # Two merges' worth of folders, however many batches there were.
    assert most <= 12


def test_stopped_merges_and_repeated_batches(spark, tmp_path):
    path = str(tmp_path)
    for number in range(5):
        batch(spark, path, number, {"a": number + 1, f"b{number}": 1})
    wanted = {"a": 5} | {f"b{n}": 1 for n in range(5)}
    # A merge that stopped: files without the mark that ends a write.
    half = spark.createDataFrame([("a", 2)], "seq string, count bigint")
    half.coalesce(1).write.parquet(f"{path}/merged=4")
    (tmp_path / "merged=4" / "_SUCCESS").unlink()
    assert keyed(spark, path) == wanted
    assert flows.merge_batches(spark, path, merge_after=5) and keyed(spark, path) == wanted
    # The last batch again, and one that is older than the merge.
    for number in (4, 2):
        batch(spark, path, number, {"a": number + 1, f"b{number}": 1})
        assert not flows.merge_batches(spark, path, merge_after=5)
        assert keyed(spark, path) == wanted


def test_a_stream_merges_its_batches(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for n in range(7):
        spark.range(n + 1).selectExpr("concat('k', id) AS seq").coalesce(1).write.mode("append").csv(source, header=True)
    stream = stream_csv(spark, source, csv_schema(spark, source), files_per_trigger=1)
    flows.to_keyed(flows.counts(stream), out, state, once=True, merge_after=2).awaitTermination()
    assert keyed(spark, out) == {f"k{n}": 7 - n for n in range(7)}
    names = {p.name for p in (tmp_path / "out").iterdir()}
    assert any(n.startswith("merged=") for n in names) and "batch=0" not in names and len(names) <= 6


def test_counts_follow_new_files(spark, tmp_path):
    for name, reads in READS.items():
        write(tmp_path, name, reads)
    write(tmp_path, "2.--csv", ["ATCA"])
    pattern = str(tmp_path / "*.csv")
    stream = stream_csv(spark, pattern, csv_schema(spark, pattern))
    flow = flows.to_memory(flows.counts(stream), "read_counts")
    try:
        flow.processAllAvailable()
        first = {r["seq"]: r["count"] for r in spark.table("read_counts").collect()}
        assert first == {"TTCA": 2, "ATCA": 1, "GTCA": 1, "CTCA": 1}
        shutil.copy(tmp_path / "2.--csv", tmp_path / "2.csv")
        flow.processAllAvailable()
        assert {r["seq"]: r["count"] for r in spark.table("read_counts").collect()}["ATCA"] == 2
    finally:
        flow.stop()


def test_stream_and_batch_classify_alike(spark, tmp_path):
    for name, reads in READS.items():
        write(tmp_path, name, reads)
    model = RuleModel([{3: 1, 5: 0}, {0: 1}], width=16)
    pattern = str(tmp_path / "*.csv")
    schema = csv_schema(spark, pattern)
    stream = stream_csv(spark, pattern, schema).withColumn("features", one_hot_vector(F.col("seq")))
    out, state = fresh_path(spark, "classified"), fresh_path(spark, "state")
    flows.to_parquet(flows.classify(stream, model).select("seq", "class"), out, state, once=True).awaitTermination()
    batch = spark.read.schema(schema).csv(pattern, header=True)
    batch = model.transform(batch.withColumn("features", one_hot_vector(F.col("seq")))).select("seq", "class")
    assert sorted(spark.read.parquet(out).collect()) == sorted(batch.collect())
    assert sorted(r["class"] for r in batch.collect()) == [0.0, 0.0, 1.0, 1.0, 1.0]
