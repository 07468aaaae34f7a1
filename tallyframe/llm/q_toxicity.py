from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_io import load
from .toxicity import fit_toxicity, toxicity


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of a quarter of the ids are held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    machine = fit_toxicity(docs, load(spark, sf_dir, "labels").where(~held))
    return toxicity(docs, machine).select("doc_id", held.alias("held_out"), "score", "predicted")
