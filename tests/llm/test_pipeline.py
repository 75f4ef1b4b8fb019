"""The pipeline stage by stage, and its run as the chain of its stages."""

import pytest

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages_chain(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, SMALL).write.parquet(path := str(tmp_path / str(i)))
        docs = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert 0 < docs.count() <= 3 * before
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).collect() == []


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, SMALL)
    good = docs.join(labels.where("quality = 1"), "doc_id").count()
    assert kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * good


@pytest.mark.parametrize("stage", [corpus_pipeline.quality_stage, corpus_pipeline.repeat_stage, corpus_pipeline.token_stage])
def test_stages_hand_on_no_python_step(spark, stage):
    """Such a step would run after the stage, with large Arrow batches of whole texts."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    plan = stage(spark, docs, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Scan parquet" in plan
