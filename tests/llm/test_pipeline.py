"""The pipeline and the registered queries over the smallest tables."""

import pytest

import corpus_pipeline
from reportloom.llm.queries import ORACLES, QUERIES

from ..compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], FOLDER).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    for before, after in zip(seen[:-2], seen[1:-1]):
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
    assert seen[2].count() < seen[1].count() <= docs.count()
    assert seen[3].count() == seen[2].count()
    assert seen[3].filter(seen[3].text.contains("[secret]")).count() > 0
    assert {r.doc_id for r in seen[5].collect()} == {r.doc_id for r in seen[4].collect()}


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_keeps_every_row(spark, name):
    found = QUERIES[name](spark, FOLDER)
    rows = found.count()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    if name.startswith("op5"):
        assert rows == 5 * spark.read.parquet(f"{FOLDER}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    elif name.startswith("op6"):
        assert rows >= docs
    elif name.startswith("op12"):  # a row a word
        assert rows == found.select("word").distinct().count() > 0
    else:
        assert rows == docs
