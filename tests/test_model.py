import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from tables import TESTDATA, instances

from clauseforge import RuleModel, load_model
from clauseforge.errors import IncompleteModelError
from clauseforge.functions.formula import formula_column
from clauseforge.plans import model as model_module
from clauseforge.plans.fixtures import part_instances
from clauseforge.plans.job import main, train_job
from clauseforge.storage import fresh_path

MODEL = RuleModel(
    [{0: 1, 2: 0}, {1: 0, 69: 1}], width=70, version="v 1", training_time=1.5, training_pos=3, training_neg=4
)


def rows70(spark):
    def row(**ones):
        values = [0.0] * 70
        for k, v in ones.items():
            values[int(k[1:])] = v
        return values

    rows = [
        (0, row(x0=1.0), 1.0),
        (1, row(x0=1.0, x2=1.0, x1=1.0), 0.0),
        (2, row(x69=1.0), 1.0),
        (3, row(x1=1.0, x69=1.0), 0.0),
        (4, row(x0=0.5, x2=0.5), 1.0),
        (5, row(), 0.0),
    ]
    return spark.createDataFrame(rows, "id int, features array<double>, wanted double")


@pytest.mark.parametrize("inline", [256, 0])
def test_classes(spark, monkeypatch, inline):
    monkeypatch.setattr(model_module, "INLINE_LITERALS", inline)
    classified = MODEL.transform(rows70(spark))
    assert classified.filter(F.col("class") != F.col("wanted")).count() == 0
    assert classified.columns == ["id", "features", "wanted", "class"]


def test_vectors_are_classified_like_arrays(spark):
    rows = [(Vectors.sparse(70, {0: 1.0}), 1.0), (Vectors.dense([0.0] * 70), 0.0)]
    df = spark.createDataFrame(rows, ["features", "wanted"])
    assert [r["class"] for r in MODEL.transform(df).collect()] == [1.0, 0.0]


def test_width_is_checked(spark):
    df = spark.createDataFrame([([1.0],)], "features array<double>")
    with pytest.raises(Exception, match="is not 70 values of 0, 0.5 or 1"):
        MODEL.transform(df).collect()


@pytest.mark.parametrize("inline", [256, 0])
@pytest.mark.parametrize("value", [0.3, 2.0, -1.0, None, float("nan")])
def test_other_values_are_an_error_in_both_forms(spark, monkeypatch, inline, value):
    monkeypatch.setattr(model_module, "INLINE_LITERALS", inline)
    df = spark.createDataFrame([([0.0, value] + [0.0] * 68,)], "features array<double>")
    with pytest.raises(Exception, match="is not 70 values of 0, 0.5 or 1"):
        MODEL.transform(df).collect()


def test_formula_and_arrays(spark):
    assert MODEL.formula == "x1x3^ + x2^x70"
    assert MODEL.term_arrays[0][:4] == [1.0, 0.0, 2.0, 0.0]
    texts = formula_column(MODEL.terms_table(spark)).orderBy("term_no").collect()
    assert " + ".join(r["term_text"] for r in texts) == MODEL.formula


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_saved_models_come_back(spark, fmt):
    path = fresh_path(spark, "model")
    MODEL.save(spark, path, fmt)
    assert load_model(spark, path, fmt) == MODEL
    with pytest.raises(Exception):
        MODEL.save(spark, path, fmt)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("ends_after", [0, 1])
def test_a_save_that_stops_leaves_no_model(spark, monkeypatch, fmt, ends_after):
    path, written = fresh_path(spark, "model"), []
    for kind in ("parquet", "text"):
        write = getattr(DataFrameWriter, kind)

        def stopping(self, target, *args, _write=write, **kwargs):
            if len(written) > ends_after:
                raise OSError("stopped")
            written.append(target)
            return _write(self, target, *args, **kwargs)

        monkeypatch.setattr(DataFrameWriter, kind, stopping)
    with pytest.raises(OSError):
        MODEL.save(spark, path, fmt)
    monkeypatch.undo()
    if fmt == "parquet" or ends_after == 0:
        with pytest.raises(IncompleteModelError):
            load_model(spark, path, fmt)
    else:
        # Both parts of a text model are there, as others write them.
        assert load_model(spark, path, fmt) == MODEL


def test_a_manifest_of_another_model_is_none(spark):
    path = fresh_path(spark, "model")
    MODEL.save(spark, path)
    spark.createDataFrame([("a.model\nb.metadata",)], "value string").write.mode("overwrite").text(f"{path}.manifest")
    with pytest.raises(IncompleteModelError):
        load_model(spark, path)


def test_text_layout(spark):
    path = fresh_path(spark, "model")
    MODEL.save(spark, path, "csv")
    lines = [r["value"] for r in spark.read.text(f"{path}.model").collect()]
    assert len(lines) == 2 and lines[0].startswith("1.0,0.0,2.0,0.0")
    meta = {r["value"] for r in spark.read.text(f"{path}.metadata").collect()}
    assert meta == {"v 1", "x1x3^ + x2^x70", "1.5", "3", "4"}


def test_training_job(spark):
    train, out = fresh_path(spark, "train"), fresh_path(spark, "model")
    part_instances(spark, f"{TESTDATA}/sf0.001").write.parquet(train)
    for strategy in ("broadcast_positive", "broadcast_negative", "cross"):
        model = train_job(spark, train, f"{out}-{strategy}", 2, 3, strategy)
        assert model.formula == "x4x8^ + x1x7"
        assert load_model(spark, f"{out}-{strategy}") == model


def test_command_line(spark, capsys):
    train, out = fresh_path(spark, "train"), fresh_path(spark, "model")
    instances(spark, [(1, 0), (0, 1)], [(0, 0), (1, 1)]).write.parquet(train)
    main([train, out, "1", "2", "--format", "csv"])
    assert "x1x2^ + x1^x2" in capsys.readouterr().out
    assert load_model(spark, out, "csv").formula == "x1x2^ + x1^x2"
