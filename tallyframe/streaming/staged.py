"""Staged responses as a stream: each file once, duplicates dropped, latest row of each key kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.grouping import latest
from ..operators.merges import insert_replace
from ..operators.snapshots import Versions
from ..sources.readers import STAGED_RESPONSE


def staged_stream(spark: SparkSession, path: str, schema: str = STAGED_RESPONSE, late: str = "1 day") -> DataFrame:
    """New files of a folder; a response that was staged twice within `late` counts once."""
    rows = spark.readStream.schema(schema).json(path)
    return rows.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["entity_type", "entity_id", "fetched_at"])


def keep_latest(stream: DataFrame, table: Versions, keys: list[str], time: str, tie: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch into a versioned table: rows that aren't older than the stored one win.  A batch that runs again gives the same version."""

    def merge(batch: DataFrame, number: int) -> None:
        new = latest(batch, keys, time, tie)
        old = table.current(batch.sparkSession)
        if old is not None:
            seen = old.select(*keys, F.col(time).alias("_seen"))
            new = new.join(seen, keys, "left").where(F.col("_seen").isNull() | (F.col(time) >= F.col("_seen"))).drop("_seen")
        table.publish(new if old is None else insert_replace(old, new, keys), f"v{number:08d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
