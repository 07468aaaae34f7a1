"""Shared-folder helpers: lineage is cut with checkpoint() only, never with local copies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, shared_dir

__all__ = ["bounded_sample", "cut", "discard", "free_name", "load", "scratch", "shared_dir", "written"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the shared folder that `written` made for `df`; for what nothing will read again."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def bounded_sample(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """About 1.2 to 1 times `size` rows, all if there are no more: those whose id hash lies under a bound that is set from the row count.

    Only these rows move, however many partitions hold the rest; the same ids are taken on every run.
    """
    n = rows.count()
    if n <= size:
        return rows
    return rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * size / n)))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
