"""Each stage of the pipeline on the smallest tables."""

from pathlib import Path

import pytest

import corpus_pipeline as pipeline

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


def test_stages_keep_columns_and_only_remove(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = pipeline.materialize(stage(spark, docs, str(DATA)), "test-stage")
        assert [c for c in docs.columns if c in names] == names
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == names
            left = {r.doc_id for r in docs.select("doc_id").collect()}
            assert left <= ids and len(left) == docs.count()
            ids = left
