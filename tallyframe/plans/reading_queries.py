"""Filters, pages, options, counts, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping, reading
from .tables import load


def multi_filter_page(spark, sf):
    """Third page of orders under a conjunction of filters, dearest first."""
    o = load(spark, sf, "orders").where(
        reading.both(
            reading.any_of(["o_orderstatus", "o_orderpriority"], "F, 1-URGENT"),
            reading.equals("o_orderstatus", "F"),
            reading.at_least("o_totalprice", 1000.0),
            reading.year_range("o_orderdate", 1996, 2001),
            reading.starts("o_orderpriority", "1"),
            reading.at_most("o_custkey", 10_000_000),
            reading.equals("o_clerk", None),
        )
    )
    keys = reading.sort_keys({"price": F.col("o_totalprice"), "date": F.col("o_orderdate")}, "price", "date", True, "o_orderkey")
    return reading.page(o, keys, 3, 25).select("o_orderkey", "o_custkey", "o_totalprice")


MULTI_FILTER = """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (o_orderstatus IN ('F', '1-URGENT') OR o_orderpriority IN ('F', '1-URGENT')) AND o_orderstatus = 'F' AND starts_with(o_orderpriority, '1') AND o_totalprice >= 1000 AND year(o_orderdate) BETWEEN 1996 AND 2001
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50
"""


def search_like(spark, sf):
    """Customers whose name or segment contains a text, letters' case aside, with their nation only because there is a text."""
    c = load(spark, sf, "customer")
    nations = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    regions = load(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return reading.enriched(c, "c_nationkey", "buil", nations, regions, "n_regionkey", ["c_name", "c_mktsegment"]).select("c_custkey", "c_mktsegment", "n_name", "r_name")


SEARCH_LIKE = "SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE lower(c_name) LIKE '%buil%' OR lower(c_mktsegment) LIKE '%buil%'"


def target_search(spark, sf):
    """Number by case, names without."""
    c = load(spark, sf, "customer").withColumn("number", F.concat(F.lit("AB"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")))
    return c.where(reading.target_search("number", ["c_name"], "AB0000")).select("c_custkey", "number")


TARGET_SEARCH = "SELECT c_custkey, 'AB' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS number FROM customer WHERE 'AB' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') LIKE '%AB0000%' OR lower(c_name) LIKE '%ab0000%'"


def list_any(spark, sf):
    """Suppliers whose distinct return flags hold one of two, and which have a known balance."""
    s = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.collect_set("l_linenumber").alias("lines")).join(load(spark, sf, "supplier"), "s_suppkey")
    s = s.withColumn("lines", F.transform("lines", lambda x: x.cast("string"))).withColumn("number", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")))
    return s.where(reading.both(reading.list_has_any("lines", ["7", "9"]), reading.presence("number", False), reading.any_known(["number", "s_acctbal"]))).select("s_suppkey")


LIST_ANY = "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber IN (7, 9))"


def text_any(spark, sf):
    p = load(spark, sf, "part")
    return p.where(reading.both(reading.any_text("p_type", ["PROM", "econ"]), reading.at_most("p_size", 20))).select("p_partkey", "p_type")


TEXT_ANY = "SELECT p_partkey, p_type FROM part WHERE (lower(p_type) LIKE '%prom%' OR lower(p_type) LIKE '%econ%') AND p_size <= 20"


def filter_options(spark, sf):
    return reading.options(load(spark, sf, "part"), "p_brand")


def option_items(spark, sf):
    p = load(spark, sf, "part").select(F.concat_ws("|", "p_brand", "p_type", F.lit(" ")).alias("item"))
    return reading.option_items(p, "item")


OPTION_ITEMS = "SELECT DISTINCT item FROM (SELECT trim(p_brand) AS item FROM part UNION SELECT trim(p_type) FROM part) WHERE item <> ''"


def top_codes_unpivot(spark, sf):
    return grouping.top_values(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"], 20)


TOP_CODES = """
SELECT code, count(*) AS n FROM (SELECT l_returnflag AS code FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem UNION ALL SELECT CAST(l_linenumber AS VARCHAR) FROM lineitem UNION ALL SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem)
WHERE code IS NOT NULL GROUP BY code ORDER BY n DESC, code LIMIT 20
"""


def status_breakdown(spark, sf):
    return grouping.counts_by(load(spark, sf, "orders"), "o_orderstatus")


def live_columns(spark, sf):
    """Columns with a value, of a cohort in which one has none."""
    c = load(spark, sf, "customer").withColumn("nothing", F.lit(None).cast("string")).withColumn("rare", F.when(F.col("c_custkey") == 1, "x"))
    return spark.createDataFrame([(n,) for n in reading.live_columns(c)], "name string")


LIVE_COLUMNS = "SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'] || CASE WHEN (SELECT count(*) FROM customer WHERE c_custkey = 1) > 0 THEN ['rare'] ELSE [] END) AS name"


def robust_outliers(spark, sf):
    """Robust log z of prices by return flag, beyond three."""
    li = load(spark, sf, "lineitem")
    stats = grouping.log_mad(li, ["l_returnflag"], "l_extendedprice")
    z = li.join(F.broadcast(stats), "l_returnflag").withColumn("z", F.round((F.log("l_extendedprice") - F.col("median_log")) / F.col("mad_log"), 6))
    return z.where(F.abs("z") > 3).select("l_orderkey", "l_linenumber", "z")


ROBUST_OUTLIERS = """
WITH x AS (SELECT *, ln(l_extendedprice) AS lx FROM lineitem WHERE l_extendedprice > 0), m AS (SELECT l_returnflag, median(lx) AS med FROM x GROUP BY 1),
d AS (SELECT l_returnflag, median(abs(lx - med)) AS mad FROM x JOIN m USING (l_returnflag) GROUP BY 1)
SELECT * FROM (SELECT l_orderkey, l_linenumber, round((lx - med) / (CASE WHEN mad = 0 THEN 1e-9 ELSE mad END * 1.4826), 6) AS z FROM x JOIN m USING (l_returnflag) JOIN d USING (l_returnflag)) WHERE abs(z) > 3
"""


def price_percentiles(spark, sf):
    out = grouping.percentiles(load(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("p5", "p50", "p95", "p99")))


PERCENTILES = "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1"


def suspicion_score(spark, sf):
    """Weighted rules over line items."""
    score, signals, bucket = grouping.suspicion([(F.col("l_discount") > 0.08, 2, "discount"), (F.col("l_quantity") > 45, 3, "quantity"), (F.col("l_tax") == 0, 1, "untaxed")])
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", score.cast("long").alias("score"), F.array_join(signals, ",").alias("signals"), bucket.alias("bucket"))


SUSPICION = """
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(2 * (l_discount > 0.08)::INT + 3 * (l_quantity > 45)::INT + (l_tax = 0)::INT AS BIGINT) AS score,
  concat_ws(',', CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_tax = 0 THEN 'untaxed' END) AS signals FROM lineitem)
SELECT *, CASE WHEN score = 0 THEN 'clean' WHEN score < 3 THEN 'minor' WHEN score < 6 THEN 'review' ELSE 'suspicious' END AS bucket FROM s
"""


def joined_distinct(spark, sf):
    """Priorities of a customer's orders in first-seen order, two at most."""
    return grouping.joined_distinct(load(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey", 2)


JOINED_DISTINCT = """
WITH f AS (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY seen) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM f)
SELECT o_custkey, string_agg(p, '; ' ORDER BY k) FILTER (WHERE k <= 2) || CASE WHEN any_value(n) > 2 THEN ' (+' || (any_value(n) - 2) || ' more)' ELSE '' END AS joined FROM r GROUP BY 1
"""


def merged_business(spark, sf):
    """Orders merged by customer, else by priority: first status, any urgent one."""
    o = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("number"), "o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice") > 200000).alias("big"))
    return grouping.merged_groups(o, "number", "o_orderpriority", "o_orderkey", ["o_orderstatus"], ["big"])


MERGED_BUSINESS = """
WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN 'n:' || o_custkey ELSE 'p:' || o_orderpriority END AS merge_key, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS st, o_totalprice > 200000 AS big FROM orders)
SELECT merge_key, count(*) AS n_rows, arg_min(st, o_orderkey) FILTER (WHERE st IS NOT NULL) AS o_orderstatus, bool_or(big) AS big FROM o GROUP BY 1
"""

QUERIES = {
    "multi_filter_page": (multi_filter_page, MULTI_FILTER),
    "search_like": (search_like, SEARCH_LIKE),
    "target_search": (target_search, TARGET_SEARCH),
    "list_any": (list_any, LIST_ANY),
    "text_any": (text_any, TEXT_ANY),
    "filter_options": (filter_options, "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL"),
    "option_items": (option_items, OPTION_ITEMS),
    "top_codes_unpivot": (top_codes_unpivot, TOP_CODES),
    "status_breakdown": (status_breakdown, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    "live_columns": (live_columns, LIVE_COLUMNS),
    "robust_outliers": (robust_outliers, ROBUST_OUTLIERS),
    "price_percentiles": (price_percentiles, PERCENTILES),
    "suspicion_score": (suspicion_score, SUSPICION),
    "joined_distinct": (joined_distinct, JOINED_DISTINCT),
    "merged_business": (merged_business, MERGED_BUSINESS),
}
