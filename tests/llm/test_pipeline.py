"""The pipeline on the smallest tables, each stage against its own rule."""

import corpus_pipeline
from pyspark.sql import functions as F

from sessionloom.llm import decontaminate, near_dedup, pii


def test_stages_keep_columns_and_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = docs.count()
        assert now <= before, name
        before = now
    assert near_dedup.duplicate_components(docs).where("not kept").count() <= 2  # redaction can make texts alike
    assert decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    assert pii.find_pii(docs).where(F.size("base") > 0).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == before
