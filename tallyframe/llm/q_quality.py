from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .quality import quality_scores
from .spark_io import load


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its own statistics and its site's posterior; kept where the score is one half or more."""
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
