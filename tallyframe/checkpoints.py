"""Cutting lineage: reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, else the one that the context has, else, on a local master only, a new one of our own (tests)."""
    context = spark.sparkContext
    has = context._jsc.sc().getCheckpointDir()
    own = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if own:
        if has.isEmpty():
            context.setCheckpointDir(own)
        return own
    if has.isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there; an executor that is lost takes none of it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
