import pytest
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F

from clauseforge.functions import encode
from clauseforge.sources.model_store import parse_rows
from clauseforge.sources.sequences import read_labelled_sequences, read_sequences


def test_one_hot_and_index(spark):
    df = spark.createDataFrame([("ACGTN",)], "seq string")
    hot = encode.encode(df, "seq").head()["features"]
    assert hot == [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0]
    assert encode.encode(df, "seq", "Index").head()["features"] == [1, 2, 3, 4, 0]
    assert df.select(encode.one_hot_active(F.col("seq")).alias("a")).head()["a"] == [0, 5, 10, 15]
    with pytest.raises(ValueError):
        encode.encode(df, "seq", "Binary")


def test_other_alphabets_and_wide_characters(spark):
    df = spark.createDataFrame([("ba\U0001f600b",), ("",)], "seq string")
    rows = df.select(encode.index_code(F.col("seq"), "ab").alias("c")).collect()
    assert [r["c"] for r in rows] == [[2, 1, 0, 2], []]


def test_vectors_and_arrays(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0, 1.0],), ([1.0, 1.0, 0.5, 1.0, 1.0],)], "features array<double>")
    vectors = encode.to_vectors(df)
    assert isinstance(vectors.schema["features"].dataType, VectorUDT)
    assert any(isinstance(r["features"], SparseVector) for r in vectors.collect())
    assert encode.to_arrays(vectors).collect() == df.collect()


def test_assemble(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    out = encode.to_arrays(encode.assemble(df, ["a", "b"])).head()["features"]
    assert out == [1.0, 0.0]


def test_csv_rows(spark):
    lines = spark.createDataFrame([("0.0,2.0,1.0",)], "value string")
    assert parse_rows(lines).head()["features"] == [0.0, 2.0, 1.0]


def test_sequence_files(spark, tmp_path):
    (tmp_path / "p.txt").write_bytes(b"ACGT\r\nTTTT\r\n")
    (tmp_path / "n.txt").write_bytes(b"CCCC\n\nGGGN")
    assert [r["seq"] for r in read_sequences(spark, str(tmp_path / "p.txt")).collect()] == ["ACGT", "TTTT"]
    both = read_labelled_sequences(spark, str(tmp_path / "p.txt"), str(tmp_path / "n.txt"))
    # An empty line is an empty sequence.
    assert sorted(map(tuple, both.collect())) == [
        ("", 0), ("ACGT", 1), ("CCCC", 0), ("GGGN", 0), ("TTTT", 1),
    ]
