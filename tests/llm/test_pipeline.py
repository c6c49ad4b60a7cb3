import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from clauseforge.llm import quality, tokens
from clauseforge.llm.queries import BYTE_BPE, ORACLE, QUERIES
from odd import odd_documents
from test_pii import BASE, valid
from test_text_rules import brute_components, brute_quality, hits
from test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stage_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "personal_data", "packing"]
    assert len([n for n in QUERIES if re.match(r"op\d+_", n)]) == 13
    assert set(ORACLE) <= set(QUERIES)


def kept_by_rules(text):
    m = dict(zip(quality.MEASURES, quality.measures(text or "")))
    return not any(eval(test.replace("AND", "and"), {}, m) for _, test in quality.RULES)


def redacted(text):
    """Base spans replaced; overlapping ones together, under the first."""
    spans = sorted(
        (m.start(), -m.end(), kind)
        for kind, pattern in BASE.items()
        for m in re.finditer(pattern, text)
        if valid(kind, m.group())
    )
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at or not out:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -end)
    return "".join([*out, text[at:]])


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def run(name, docs):
        out = corpus_pipeline.stored(stages[name](spark, docs, SF), name)
        return out, {r[0]: r[1] for r in out.select("doc_id", "text").collect()} if name != "packing" else None

    docs, after = run("quality", docs)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    wanted = {i: t for i, t in rows.items() if kept_by_rules(t)}
    assert after == wanted and not any(brute_quality(i, t)[-1] for i, t in after.items())
    docs, after = run("near_dedup", docs)
    wanted = {i: wanted[i] for i, _, _, kept in brute_components(sorted(wanted.items())) if kept}
    assert after == wanted
    docs, after = run("decontamination", docs)
    wanted = {i: t for i, t in wanted.items() if not hits(t, items)[4]}
    assert after == wanted
    docs, after = run("personal_data", docs)
    assert set(after) == set(wanted)
    for i, text in after.items():
        more = re.sub(r"\[(?:SECRET|NUMBER|MAIL)\]", "", text)
        if more == text:
            assert text == redacted(wanted[i])
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    docs, _ = run("packing", docs)
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path(BYTE_BPE))
    check_packing(docs.collect(), sorted(after.items()), tokenizer, 2048)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    docs = odd_documents(spark)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert name == "packing" or out.columns == docs.columns
    out.collect()
    none = dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), SF)
    assert none.count() == 0
