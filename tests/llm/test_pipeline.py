"""The pipeline's stages, one after another, and the columns they return."""

import corpus_pipeline


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= before
        before = now
    assert 50 < len(before) < 200


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns) and out.where("n_tokens = 0 OR n_tokens <> size(ids)").count() == 0
