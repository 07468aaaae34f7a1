from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .quality_rules import quality_rules
from .spark_io import load


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers by language and source, for every document."""
    return quality_rules(load(spark, sf_dir, "documents"))
