from __future__ import annotations

import corpus_pipeline
import pytest

from tablelens.llm import simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= 3 * before, name
    assert docs.where("NOT round_trip").count() == 0 and docs.where("n_pieces != size(piece_ids)").count() == 0


def test_run_equals_stage_by_stage_rows(spark):
    first = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect())
    assert first == sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect())


@pytest.mark.parametrize("full", [64, 2])
def test_one_of_each_group_stays(spark, odd_rows, full):
    rows = [(*r, 0, {"a": 1}) for r in odd_rows] + [(50, "same text of some words", 1, None), (None, "other", 2, None), (None, "other", 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, m map<string,int>")
    got = simhash.deduplicated(df, full_bucket=full)
    assert got.columns == df.columns
    components = simhash.simhash_components(df).select("component").distinct().count()
    kept = got.collect()
    assert len(kept) <= len(df.collect()) and len({r["text"] for r in kept}) == len(kept) >= components
    assert [r["doc_id"] for r in kept if r["text"] == "same text of some words"] == [7]
