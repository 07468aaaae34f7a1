"""Session settings and shipping of this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: dict[str, str] = {}


def build_session(master: str = "local[*]", app: str = "tallyframe", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC, AQE on, Arrow on."""
    builder = SparkSession.builder.master(master).appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        base["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tallyframe-ship-"), "tallyframe-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith((".py", ".csv")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tallyframe", os.path.relpath(full, PACKAGE)))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path
