from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .pieces import encode_texts
from .spark_io import load


def model_path() -> str:
    """The public model's file; its folder is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_texts(docs, model_path(), "text", "ids", "round_trip").drop("text")
    return coded.selectExpr("doc_id", "size(ids) AS n_ids", "round_trip", "ids")
