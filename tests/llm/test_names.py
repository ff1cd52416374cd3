"""Columns named like those that operators add for themselves pass through."""

import pytest

import corpus_pipeline
from skytile.llm import lines, mixing, surrogates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _pii_row int, pii_row int, _mix_plan string, mix_plan int, mix1_own int, _rep_id int, rep_id int, _lang_id int, lang_id int, line_doc int"
ROWS = [(i, f"Mr. Ray Cole wrote to ray.cole{i}@example.com about the number {i} of the good words and the others", "en" if i % 2 else "de", "ab"[i % 2], 10, *range(9), i) for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_surrogates(docs):
    got = surrogates.replace(docs, b"key").orderBy("doc_id").collect()
    assert [(r._pii_row, r.pii_row, r.line_doc) for r in got] == [(0, 1, i) for i in range(12)] and all("Cole" not in r.text for r in got)


def test_mixing(docs):
    got = mixing.mix(docs).where("mix_epoch = 0").collect()
    assert len(got) == 12 and {(r._mix_plan, r.mix_plan, r.mix1_own) for r in got} == {("2", 3, 4)}


def test_lines(docs):
    assert {r.line_doc for r in lines.dedup_lines(docs).collect()} == set(range(12))


def test_stages(spark, docs):
    out = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns and {(r._rep_id, r.rep_id, r._lang_id, r.lang_id) for r in out.collect()} <= {(5, 6, 7, 8)}
