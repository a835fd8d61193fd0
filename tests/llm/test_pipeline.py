"""The pipeline's stages, each judged on its own input."""

import pytest
from conftest import SF

import corpus_pipeline
from webstrata.llm import decontamination, mixing, ngram_join


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{at}/{k}")
        out.append(spark.read.parquet(f"{at}/{k}"))
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "size", "copy"]


def test_stages_keep_what_they_should(spark, steps):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert ids[2] == ids[1] <= ids[0] and ids[3] < ids[2] and ids[4] < ids[3] and ids[5] <= ids[4]
    classes = {r.doc_id: r.class_id for r in ngram_join.similar_documents(steps[2]).collect()}
    assert ids[3] == set(classes.values())
    judged = decontamination.scan(steps[3], spark.read.parquet(f"{SF}/benchmark.parquet"), slop=-1)
    assert ids[4] == {r.doc_id for r in judged.where("not contaminated").collect()}
    copies = {r.doc_id: r.copies for r in mixing.with_copies(steps[4].withColumn("size", mixing.n_words())).collect()}
    assert {r.doc_id: r["count"] for r in steps[5].groupBy("doc_id").count().collect()} == {d: c for d, c in copies.items() if c}
