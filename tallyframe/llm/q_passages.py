from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .passages import repeated_passages
from .spark_io import load


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that a document of lesser id holds as well."""
    return repeated_passages(load(spark, sf_dir, "documents")).drop("version")
