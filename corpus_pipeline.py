"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes all that its predecessor kept and returns the columns of `documents`; the
last one returns each remaining document with its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.decontaminate import without_leaks
from tallyframe.llm.minhash import first_of_groups
from tallyframe.llm.passages import without_repeats
from tallyframe.llm.pieces import encode_texts
from tallyframe.llm.q_pieces import model_path
from tallyframe.llm.quality import keep_quality
from tallyframe.llm.spark_io import discard, load, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return keep_quality(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates on five-word shingles."""
    return first_of_groups(docs, size=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of lesser id holds."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, load(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether they decode to its text."""
    coded = encode_texts(docs, model_path(), "text", "ids", "round_trip")
    return coded.select("doc_id", "lang", "source", "ids", "round_trip")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]
#: Learned weights, similarity groups and tokenization have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written to the shared folder and read again as the next one's input.

    A result that the next one has been written from is deleted; the last one is read by the caller.
    """
    docs, last = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(spark, last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
