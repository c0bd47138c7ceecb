"""The pipeline's stages on a small table, each on what the one before kept."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

from veritab.llm.common import cut, table  # noqa: E402


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, n = docs.columns, docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        seen[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert seen["quality_rules"] < n and seen["near_dedup"] <= seen["quality_rules"] and seen["decontamination"] < seen["near_dedup"]
    assert seen["token_output"] == seen["source_mixing"]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
