from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import benchmark_leaks
from .spark_io import load


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a copy or an edited copy of a benchmark item, with the item."""
    return benchmark_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
