"""Every stage of the pipeline on nulls, empty and repeated rows, very long texts, more columns, and nothing at all."""

import corpus_pipeline
import pytest
from conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, key string, n long, row string"
PLAIN = "The committee met on Tuesday to talk about the plan for the new library, and most of those who came were in favour of it. "
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, PLAIN * 3), (4, PLAIN * 3), (5, PLAIN * 3), (6, PLAIN * 400), (None, PLAIN), (None, None), (7, "日本語 " * 50), (8, "x" * 5000)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 0, "w", "k", 1, "r") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, name, stage):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = table(spark, ROWS)
    if name in ("quality", "toxicity"):  # these learn from the labelled documents among their own
        docs = docs.unionByName(documents.where("doc_id > 8"), allowMissingColumns=True)
    out = stage(spark, docs, DATA)
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
        return
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    given = {(r.doc_id, r.text) for r in docs.collect()}
    if name == "line_dedup":
        assert len(rows) == docs.count() and {r.doc_id for r in rows} == {i for i, _ in given}
    else:
        assert {(r.doc_id, r.text) for r in rows} <= given
    if name == "near_dedup":
        assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 7, 8}  # 5 and 6 say what 4 says


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_of_nothing(spark, name, stage):
    out = stage(spark, table(spark, []), DATA)
    assert out.count() == 0 and (name == "packing" or out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "))
