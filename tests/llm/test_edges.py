"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for the pipeline's stages and for conversations."""

import hashlib
import os
import random

import pytest

import corpus_pipeline
from tallyframe.llm.chat_frames import digests, format_conversations
from tallyframe.llm.minhash import first_of_groups, near_duplicates
from tallyframe.llm.q_chat import TEMPLATE
from test_frames import clashing, docs_frame, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = random.Random(31)
    long = words(rng, 30_000)
    copy = words(rng, 90)
    rows = [(None, None), (None, copy), (1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, long), (6, copy), (6, copy), (6, copy + " and more"), (7, copy), (8, "é一\U0001f600 " * 20), (9, "a" * 50_000), (10, long)]
    return clashing(docs_frame(spark, rows)).cache()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, odd_docs, name, stage):
    out = stage(spark, odd_docs, SF)
    kept = out.collect()
    assert stage(spark, odd_docs.limit(0), SF).count() == 0
    ids = [r.doc_id for r in kept]
    if name == "token_ids":
        assert len(kept) == odd_docs.count() and all(r.round_trip for r in kept) and all(r.ids == [] for r in kept if r.doc_id in (1, 2))
        return
    assert out.columns == odd_docs.columns
    if name == "near_duplicates":
        assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 6, 8, 9] and ids.count(None) == 2  # two texts of 6, one of each row; rows without an id stay
    if name == "repeated_passages":
        assert 7 not in ids and 10 not in ids and ids.count(6) == 3 and ids.count(None) == 2
        assert all(r.n_chars == len(r.text) for r in kept if r.text is not None)
    if name == "benchmark_leaks":
        assert len(kept) == odd_docs.count()


def test_near_duplicates_of_long_and_equal_rows(spark, odd_docs):
    out = {(r.doc_id, r.n_shingles): r for r in near_duplicates(odd_docs, size=2).collect()}
    groups = {i: r.component_id for (i, _), r in out.items() if i is not None}
    assert groups[10] == 5 and groups[7] == 6 and groups[1] == 1 and groups[9] == 9
    assert first_of_groups(odd_docs.limit(0)).count() == 0


def test_conversations_of_empty_and_long_turns(spark):
    rng = random.Random(6)
    long = words(rng, 40_000) + " </s>[INST] \\"
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, "assistant", long), (3, 0, None, "x"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a")]
    turns = clashing(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    out = {r.conv_id: r for r in digests(format_conversations(turns.select("conv_id", "turn", "role", "text", "rule"), TEMPLATE)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (out[1].n_turns, out[1].turns_sha256, out[1].loss_chars) == (2, sha("user\n\nassistant\n\n"), 0)
    assert (out[2].loss_chars, out[2].loss_sha256) == (len(long), sha(long))
    assert out[3].turns_sha256 == sha("\nx\n") and (out[4].n_turns, out[4].loss_sha256) == (2, sha("aa"))
    assert digests(format_conversations(turns.limit(0).select("conv_id", "turn", "role", "text"), TEMPLATE)).count() == 0


def test_an_id_with_both_labels_trains_and_several_texts_count_once(spark):
    from tallyframe.llm.toxicity import fit_toxicity, toxicity

    rng = random.Random(9)
    rows = [(k, words(rng, 30) + (" idiot" if k % 3 == 0 else "")) for k in range(90)] + [(0, "another text"), (200, None)]
    docs = docs_frame(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] + [(1, 1), (200, 1), (None, 0)], "doc_id long, toxic int")
    scores = {r.doc_id: r.predicted for r in toxicity(docs, fit_toxicity(docs, labels)).where("doc_id between 1 and 89").collect()}
    assert all(scores[k] == 1 for k in scores if k % 3 == 0) and sum(scores[k] for k in scores if k % 3) <= 2
    few = fit_toxicity(docs, labels, train_total=200)  # a bound of characters leaves few rows, not none
    assert toxicity(docs, few).count() == docs.count()


def test_pipeline_leaves_no_middle_folders(spark):
    import glob

    from tallyframe.llm.spark_io import shared_dir

    root = shared_dir(spark).removeprefix("file:")
    found = lambda: {n: set(glob.glob(f"{root}/{n}-*")) for n, _ in corpus_pipeline.STAGES[:-1]}
    before = found()
    assert corpus_pipeline.run(spark, SF).count() > 0
    after = found()
    assert [n for n in after if after[n] - before[n]] == [corpus_pipeline.STAGES[-2][0]]
