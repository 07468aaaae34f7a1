import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "token_ids"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_run_is_its_stages(spark):
    from pyspark.sql import functions as F
    from test_minhash import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert 0 < docs.count() <= before.count()
        if name == "near_duplicates":
            groups = brute([(r.doc_id, r.text) for r in before.collect()], 5)
            assert {r.doc_id for r in docs.collect()} == {i for i, g in groups.items() if g[2]}
        if name != "token_ids":
            assert docs.columns == columns
            if name != "repeated_passages":
                assert docs.join(before, columns, "left_anti").count() == 0  # rows go, none changes
            else:
                assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    assert docs.where("not round_trip").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids) for r in whole.select("doc_id", "ids").collect()) == sorted((r.doc_id, r.ids) for r in docs.select("doc_id", "ids").collect())
