"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from tables import TESTDATA

from __spark_entry__ import entry, oracle_sql, queries
from clauseforge.plans import fixtures
from tools.compare import canonical

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    mine = queries()[name](spark, SF).toPandas()
    theirs = sql.execute(oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


def test_entry(spark):
    assert entry(spark).columns == ["id", "class"]


def test_words_are_those_of_ascii_letters_and_found_once(spark, tmp_path):
    # Letters outside ASCII part words, also those whose small form is an ASCII letter.
    texts = ["With und WITH x", "\u212aelvin \u0130stanbul Ab1ab", "", "été BÉby\nwith", None]
    rows = [(i, text, "en") for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    documents = fixtures.table(spark, str(tmp_path), "documents")
    found = documents.select("doc_id", fixtures.ascii_words(F.col("text")).alias("words")).orderBy("doc_id").collect()
    assert [r.words and [w for w in r.words if w] for r in found] == [
        ["with", "und", "x"], ["elvin", "stanbul", "ab"], [], ["t", "b", "by", "with"], None,
    ]
    instances = fixtures.word_shape_instances(spark, str(tmp_path))
    plan = instances._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(text") == 1 and "translate(" not in plan
    got = {r.id: (r.label, r.features.indices) for r in instances.where("id < 4").collect()}
    assert got[0] == (1, [(22 * 26 + 8) * 3 + 2, (20 * 26 + 13) * 3 + 1])
    assert got[2] == (0, []) and got[3][0] == 0
