"""History-keeping merges of full snapshots, and the gates before them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import percent_change
from .grouping import duplicate_keys

TRACKING = {"is_active": "boolean", "first_scrape_date": "date", "last_scrape_date": "date", "marked_inactive_scrape_date": "date", "last_enriched_at": "timestamp"}


class GateError(ValueError):
    """A snapshot doesn't pass; `report` has the figures."""

    def __init__(self, failures: list[str], report: dict):
        super().__init__("; ".join(failures))
        self.failures, self.report = failures, report


def bootstrap(staging: DataFrame, scrape_date: str) -> DataFrame:
    """First load: every row is active and new."""
    day = F.lit(scrape_date).cast("date")
    values = {"is_active": F.lit(True), "first_scrape_date": day, "last_scrape_date": day}
    return staging.withColumns({c: values.get(c, F.lit(None)).cast(t) for c, t in TRACKING.items()})


def upsert(old: DataFrame, staging: DataFrame, key: str, scrape_date: str, fill_first_seen: bool = True) -> DataFrame:
    """One full outer join: matched rows take the new data and keep when they were first seen and last enriched; new rows are
    new; rows that are gone keep their data, inactive since the first time.

    Columns that only `old` has are null on matched rows (a row from another source becomes a snapshot row) and kept on rows that are gone.
    With `fill_first_seen` a missing first date becomes this one.  Keys must be unique on both sides, which the gate checks.
    """
    day = F.lit(scrape_date).cast("date")
    data = [c for c in old.columns if c not in TRACKING]
    n, o = staging.withColumn("_new", F.lit(True)).alias("n"), old.alias("o")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    seen = F.col("n._new").isNotNull()
    new = lambda c: F.col(f"n.{c}") if c in staging.columns else F.lit(None)
    kinds = dict(old.dtypes)
    first = F.coalesce("o.first_scrape_date", day) if fill_first_seen else F.when(F.col(f"o.{key}").isNotNull(), F.col("o.first_scrape_date")).otherwise(day)
    tracking = {
        "is_active": seen,
        "first_scrape_date": F.when(seen, first).otherwise(F.col("o.first_scrape_date")),
        "last_scrape_date": F.when(seen, day).otherwise(F.col("o.last_scrape_date")),
        "marked_inactive_scrape_date": F.when(~seen, F.coalesce("o.marked_inactive_scrape_date", day)),
        "last_enriched_at": F.col("o.last_enriched_at") if "last_enriched_at" in old.columns else None,
    }
    return joined.select(
        *(F.when(seen, new(c)).otherwise(F.col(f"o.{c}")).cast(kinds[c]).alias(c) for c in data),
        *(v.alias(c) for c, v in tracking.items() if c in old.columns and v is not None),
    )


def gate_figures(old: DataFrame, staging: DataFrame, key: str, only_active: bool = True, counted=None) -> DataFrame:
    """One row: duplicate keys, row change and churn in percent (null before an empty table).

    `counted` limits which old rows count (rows of other sources don't); `only_active` compares with active rows only.
    """
    base = old if counted is None else old.where(counted)
    active = base.where("is_active")
    before = (active if only_active else base).agg(F.count("*").alias("old_total"))
    after = staging.agg(F.count("*").alias("new_total"))
    live = active.agg(F.count("*").alias("currently_active"))
    gone = active.join(staging.select(key), key, "left_anti").agg(F.count("*").alias("would_be_inactivated"))
    row = before.crossJoin(after).crossJoin(live).crossJoin(gone).crossJoin(duplicate_keys(staging, key))
    share = F.round(F.lit(100.0) * F.col("would_be_inactivated").cast("double") / F.nullif(F.col("currently_active").cast("double"), F.lit(0.0)), 2)
    return row.withColumns({"row_delta": F.col("new_total") - F.col("old_total"), "row_pct": percent_change("new_total", "old_total"), "inactive_pct": share})


def enforce(figures: DataFrame, force: bool = False, most_rows: float = 5.0, most_churn: float = 5.0) -> dict:
    """Raise on duplicate keys always, on too large changes unless forced; returns the figures."""
    report = figures.first().asDict()
    hard = [f"{report['dup_distinct']} keys repeat, such as {report['dup_sample']}"] if report["dup_distinct"] else []
    soft = [f"{name} {report[c]} % is over {most} %" for name, c, most in (("row change", "row_pct", most_rows), ("churn", "inactive_pct", most_churn)) if report[c] is not None and report[c] > most]
    if hard or (soft and not force):
        raise GateError(hard + soft, report)
    return report


def replace_gate(old_rows: int | None, staging: DataFrame, key: str, filled: str, force: bool = False, most_rows: float = 10.0, least_filled: float = 10.0) -> dict:
    """Gate of a full replacement: empty or repeated keys are hard failures, row change and a scarcely filled column forceable."""
    row = staging.agg(F.count("*").alias("new_total"), F.round(100.0 * F.avg(F.col(filled).isNotNull().cast("int")), 2).alias("filled_pct"))
    report = row.crossJoin(duplicate_keys(staging, key)).first().asDict() | {"old_total": old_rows}
    hard = ["no rows"] if not report["new_total"] else []
    hard += [f"{report['dup_distinct']} keys repeat"] if report["dup_distinct"] else []
    soft = [] if not old_rows else [f"row change over {most_rows} %"] if abs(report["new_total"] - old_rows) * 100.0 / old_rows > most_rows else []
    soft += [f"{filled} is filled in {report['filled_pct']} %"] if report["new_total"] and report["filled_pct"] < least_filled else []
    if hard or (soft and not force):
        raise GateError(hard + soft, report)
    return report


@dataclass
class Versions:
    """A table as one directory a version, with numbered pointer files of which the highest counts.

    A pointer is written under another name and renamed to a name that wasn't there before, so at every moment, and after a crash
    at any, readers see the old version or the new one.
    """

    root: str

    def current(self, spark) -> DataFrame | None:
        last = self._last(spark)
        return None if last is None else spark.read.parquet(f"{self.root}/{last[1]}")

    def publish(self, df: DataFrame, name: str) -> None:
        """Write a version, then point to it.  A version that is current already is complete, so it is left alone."""
        spark = df.sparkSession
        last = self._last(spark)
        if last and last[1] == name:
            return
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        number = last[0] + 1 if last else 0
        new, now = self._path(spark, f"pointers/.new-{name}"), self._path(spark, f"pointers/{number:012d}-{name}")
        fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.create(new, True).close()
        if not fs.rename(new, now):
            raise OSError(f"{now} wasn't made")

    def _last(self, spark) -> tuple[int, str] | None:
        """Number and version of the highest pointer."""
        folder = self._path(spark, "pointers")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        found = max((n for n in names if n[:1].isdigit()), default=None)
        return None if found is None else (int(found[:12]), found[13:])

    def _path(self, spark, name: str):
        return spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")


def replay(months: dict[str, DataFrame], load: Callable[[str, DataFrame], None]) -> list[str]:
    """Load month by month in ascending order; returns the order."""
    order = sorted(months)
    for month in order:
        load(month, months[month])
    return order
