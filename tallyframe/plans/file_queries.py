"""Readers, writers and the stream, as round trips through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..checkpoints import shared_dir
from ..operators import merges, snapshots
from ..sources import documents, readers, sinks
from ..streaming import staged
from .tables import load


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def csv_round_trip(spark, sf):
    """Customers as ordered CSV part files and back, with lines that don't fit counted."""
    path = _folder(spark, "csv")
    c = load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.concat(F.lit('a "b", '), "c_name").alias("c_name"), "c_mktsegment")
    n = sinks.write_csv(c, f"{path}/good", [F.col("c_mktsegment"), F.col("c_custkey").cast("long")])
    broken = c.where("c_custkey % 10 = 0").select(F.concat_ws(",", "c_custkey", F.lit("x"), F.lit("y"), F.lit("too many")).alias("c_custkey,c_name,c_mktsegment"))
    broken.write.option("header", True).option("sep", "\x01").csv(f"{path}/bad")
    names = ["c_custkey", "c_name", "c_mktsegment"]
    raw, bad = (readers.read_csv(spark, f"{path}/{side}", names) for side in ("good", "bad"))
    return readers.good_rows(raw).select("c_custkey", "c_name", "c_mktsegment", F.lit(n).cast("long").alias("written"), F.lit(readers.rejected_rows(bad).first().rejected).cast("long").alias("rejected"))


CSV_ROUND_TRIP = """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'a "b", ' || c_name AS c_name, c_mktsegment, (SELECT count(*) FROM customer) AS written, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS rejected FROM customer
"""


def staged_lines(spark, sf):
    """Events staged as JSON lines by two writers, one of which died in its last line; read without that line."""
    path = _folder(spark, "staged")
    e = load(spark, sf, "events").select(F.lit("event").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("http_status"), "props")
    rows = e.withColumnRenamed("props", "raw_json")
    sinks.write_staged(rows.where("http_status % 2 = 0"), path)
    whole = rows.where("http_status % 2 = 1").select(F.to_json(F.struct("*")).alias("value"))
    torn = spark.createDataFrame([('{"entity_type":"event","entity',)], "value string")
    lines = whole.withColumn("last", F.lit(0)).unionByName(torn.withColumn("last", F.lit(1))).coalesce(1).sortWithinPartitions("last").select("value")  # the fixture of one writer's file
    lines.write.mode("append").text(path)
    bad = readers.torn_lines(spark, path).where("bad > 0").agg(F.sum("bad").alias("n"), F.min("last_bad").alias("ends")).first()
    found = readers.repaired(spark, path)
    return found.select(F.col("http_status").alias("event_id"), "entity_id", F.col("raw_json").alias("props"), F.lit(bad.n).cast("long").alias("torn"), F.lit(bad.ends).alias("at_the_end"))


STAGED_LINES = "SELECT event_id, CAST(user_id AS VARCHAR) AS entity_id, props, 1::BIGINT AS torn, TRUE AS at_the_end FROM events"


def bundle_import(spark, sf):
    """Nations as a bundle, imported over changed ones by key and as a replacement."""
    path = _folder(spark, "bundle")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.write_bundle({"nation": n.where("n_nationkey % 2 = 0"), "region": load(spark, sf, "region")}, path)
    bundle = sinks.read_bundle(spark, path)
    now = {"nation": n.where("n_nationkey < 20").withColumn("n_name", F.lit("old")), "more": n}
    merged = sinks.import_bundle(now, bundle, {"nation": ["n_nationkey"], "region": ["r_regionkey"]})
    replaced = sinks.import_bundle(now, bundle, {}, replace=True)
    return merged["nation"].withColumn("side", F.lit("merged")).unionByName(replaced["nation"].withColumn("side", F.lit("replaced"))).withColumn("tables", F.lit(len(merged)).cast("long"))



BUNDLE_IMPORT = """
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'old' END AS n_name, n_regionkey, 'merged' AS side, 3::BIGINT AS tables FROM nation WHERE n_nationkey < 20 OR n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'replaced', 3 FROM nation WHERE n_nationkey % 2 = 0
"""


def stream_latest(spark, sf):
    """Events staged in three steps and read as a stream after each: the latest answer of each user, whatever the order of the files; the last step repeats one."""
    path = _folder(spark, "stream")
    e = load(spark, sf, "events").select(F.lit("event").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("http_status"), F.col("props").alias("raw_json"))
    table = snapshots.Versions(f"{path}/table")
    for part in ("http_status % 3 = 2", "http_status % 3 = 0", "http_status % 3 = 1 or http_status % 30 = 2"):
        sinks.write_staged(e.where(part), f"{path}/files")
        staged.keep_latest(staged.staged_stream(spark, f"{path}/files", late="100000 days"), table, ["entity_id"], "fetched_at", "http_status", f"{path}/checkpoint").awaitTermination()
    return table.current(spark).select("entity_id", F.col("http_status").alias("event_id"), "raw_json")


STREAM_LATEST = """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT CAST(user_id AS VARCHAR) AS entity_id, event_id, props AS raw_json FROM f WHERE k = 1
"""


def page_rows(spark, sf):
    """Visible rows of every page."""
    return documents.text_rows(load(spark, sf, "pages").select("page_id", "html"), "html").select("page_id", F.size("rows").cast("long").alias("n_rows"), F.array_join("rows", "\n").alias("text"))


def replace_and_conflict(spark, sf):
    """Orders put over older ones in listed columns only, and a snapshot loaded month by month in order."""
    o = load(spark, sf, "orders")
    old = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("old").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    out = merges.insert_replace(old, o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"], ["o_orderstatus"])
    months = {m: o.limit(0) for m in ("2024-03-01", "2024-01-01", "2024-02-01")}
    seen: list[str] = []
    order = snapshots.replay(months, lambda month, _: seen.append(month))
    return out.withColumn("months", F.lit(",".join(seen if seen == order else [])))


REPLACE_AND_CONFLICT = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'old' END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 END::DOUBLE AS o_totalprice, '2024-01-01,2024-02-01,2024-03-01' AS months FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
"""

QUERIES = {
    "csv_round_trip": (csv_round_trip, CSV_ROUND_TRIP),
    "staged_lines": (staged_lines, STAGED_LINES),
    "bundle_import": (bundle_import, BUNDLE_IMPORT),
    "stream_latest": (stream_latest, STREAM_LATEST),
    "page_rows": (page_rows, None),
    "replace_and_conflict": (replace_and_conflict, REPLACE_AND_CONFLICT),
}
