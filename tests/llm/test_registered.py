"""Registered queries of the subpackage on the smallest data, and the pipeline's stages against its operators' brute force."""

import os

import pytest

import corpus_pipeline
from allelegate.llm.queries import ORACLES, QUERIES
from allelegate.llm.tables import stored
from oracle import compare, duck
from test_forest import brute

SF_DIR = "/root/testdata/sf0.001"
ROWS = {"op1": "pages", "op4": "pages", "op6": None, "op11": None, "op13": None}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    rows, _, note = compare(spark, duck(SF_DIR), name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert note == ("ok" if name in ORACLES else "no sql")
    table = ROWS.get(name.split("_")[0], "documents")
    assert table is None or rows == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, SF_DIR), "stage")
        if name != "sentencepiece":
            assert after.columns == columns
        kept = {r[0] for r in after.select("doc_id").collect()}
        given = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
        assert kept <= set(given) and after.count() == len(kept)
        if name == "line dedup" or name == "sentencepiece":
            assert kept == set(given)
        if name == "near dedup":
            assert kept == {i for i, _, _, stays in brute(list(given.items()), 5, 80) if stays}
        before = after
    assert before.where("not round_trip").isEmpty()
    assert corpus_pipeline.run(spark, SF_DIR).count() == before.count()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]])
def test_stages_take_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), "stage")
    assert docs.count() <= len(rows)
