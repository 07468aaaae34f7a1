"""Scoring, windows and joins of the headline read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import grouping, scoring
from .tables import load


def _verdict():
    words = ["Majority domiciliary", "Mixed_domiciliary_supported", "Majority Supported living", "Mixed_residential_domiciliary", "likely domicilairy care", "Unable to classify"]
    return F.element_at(F.array(*map(F.lit, words)), (F.col("c_custkey") % 6 + 1).cast("int"))


def tiered_scoring(spark, sf):
    """Customers as companies: the best supplier of their orders as match, ages from orders, size from spending, a tenth excluded by list."""
    customer, orders, supplier = load(spark, sf, "customer"), load(spark, sf, "orders"), load(spark, sf, "supplier")
    bought = orders.join(load(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    companies = customer.select(F.col("c_custkey").alias("company_number"), F.col("c_name").alias("company_name"), "c_nationkey", "c_mktsegment")
    matches = bought.select(
        F.col("c_custkey").alias("company_number"),
        F.col("s_suppkey").alias("provider_id"),
        F.element_at(F.array(F.lit("auto_confirmed"), F.lit("needs_review"), F.lit("user_rejected")), ((F.col("c_custkey") + F.col("s_suppkey")) % 3 + 1).cast("int")).alias("status"),
        (F.col("s_suppkey") % 11 + 80).cast("long").alias("total_score"),
        F.to_date(F.lit("2024-01-01")).alias("matched_at"),
    )
    sites = supplier.select(F.col("s_suppkey").alias("provider_id"), F.when(F.col("s_suppkey") % 2 == 0, "Homecare agencies|Supported living").otherwise("Residential homes").alias("service_types"))
    spent = orders.groupBy(F.col("o_custkey").alias("company_number")).agg(F.round(F.sum("o_totalprice") * 8, 2).alias("revenue"), F.count("*").alias("n"))
    enrichment = spent.select("company_number", "revenue", (F.col("n") + 45).alias("avg_director_age"), (F.col("n") % 3).alias("directors_over_60"), (F.col("n") % 7 == 0).alias("all_directors_60_plus"))
    rows = customer.select(F.col("c_custkey").alias("company_number"), _verdict().alias("verdict"), F.lit("website").alias("source_type"), F.to_date(F.lit("2024-01-01")).alias("classified_at"))
    exclusions = customer.where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("company_number"), F.when(F.col("c_custkey") % 20 == 3, "on").otherwise("off").alias("list_name"))
    lists = spark.createDataFrame([("on", True), ("off", False)], "list_name string, is_active boolean")
    out = scoring.tiered_targets(companies, matches, sites, sites, enrichment, rows, exclusions, lists)
    long = lambda c: F.col(c).cast("long")
    return out.select("company_number", "company_name", "provider_id", "match_status", "verdict", "sources_agreement", *(long(c).alias(c) for c in ("class_pts", "service_pts", "age_pts", "size_pts", "total_score")), "tier")


TIERED_SCORING = """
WITH verdicts AS (
  SELECT c_custkey AS company_number, ['Majority domiciliary', 'Mixed_domiciliary_supported', 'Majority Supported living', 'Mixed_residential_domiciliary', 'likely domicilairy care', 'Unable to classify'][1 + c_custkey % 6] AS verdict FROM customer
), m AS (
  SELECT c_custkey AS company_number, s_suppkey AS provider_id, ['auto_confirmed', 'needs_review', 'user_rejected'][1 + (c_custkey + s_suppkey) % 3] AS status, s_suppkey % 11 + 80 AS total_score
  FROM (SELECT DISTINCT o_custkey AS c_custkey, l_suppkey AS s_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_number ORDER BY CASE status WHEN 'auto_confirmed' THEN 2 ELSE 3 END, total_score DESC, provider_id) AS k FROM m WHERE status <> 'user_rejected') WHERE k = 1
), e AS (
  SELECT o_custkey AS company_number, round(sum(o_totalprice) * 8, 2) AS revenue, count(*) AS n FROM orders GROUP BY 1
), p AS (
  SELECT c.c_custkey AS company_number, c_name AS company_name, provider_id, status AS match_status, verdict,
    CASE c.c_custkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 3 ELSE 0 END AS class_pts,
    CASE WHEN provider_id % 2 = 0 THEN 2 ELSE 0 END AS service_pts,
    CASE WHEN n IS NULL THEN 0 WHEN n % 7 = 0 THEN 3 WHEN n % 3 >= 1 AND n + 45 >= 55 THEN 2 WHEN n + 45 >= 50 THEN 1 ELSE 0 END AS age_pts,
    CASE WHEN revenue BETWEEN 5e6 AND 25e6 THEN 2 WHEN revenue BETWEEN 1e6 AND 4999999.999999 THEN 1 WHEN revenue > 25e6 AND revenue <= 50e6 THEN 1 ELSE 0 END AS size_pts
  FROM customer c JOIN best ON best.company_number = c.c_custkey JOIN verdicts v ON v.company_number = c.c_custkey LEFT JOIN e ON e.company_number = c.c_custkey
  WHERE c.c_custkey % 20 <> 3
), t AS (SELECT *, greatest(class_pts, service_pts) AS eff, greatest(class_pts, service_pts) + age_pts + size_pts AS total FROM p)
SELECT company_number, company_name, provider_id, match_status, verdict, 'single_source' AS sources_agreement, CAST(class_pts AS BIGINT) AS class_pts, CAST(service_pts AS BIGINT) AS service_pts,
  CAST(age_pts AS BIGINT) AS age_pts, CAST(size_pts AS BIGINT) AS size_pts, CAST(total AS BIGINT) AS total_score,
  CASE WHEN eff = 0 OR total = 0 THEN 'Excluded' WHEN total >= 6 THEN 'Tier 1' WHEN total >= 4 THEN 'Tier 2' ELSE 'Tier 3' END AS tier
FROM t
"""


def best_match_window(spark, sf):
    """Best order a customer by status, price, date and key."""
    orders = load(spark, sf, "orders")
    best = grouping.first_by(orders, "o_custkey", grouping.ranked("o_orderstatus", ["F", "P", "O"]), F.desc("o_totalprice"), F.desc("o_orderdate"), F.col("o_orderkey"))
    return best.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


BEST_MATCH = """
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 WHEN 'O' THEN 3 ELSE 99 END, o_totalprice DESC, o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1
"""


def source_agreement(spark, sf):
    """Latest best-ranked event a user, with how many there are and whether they agree."""
    events = load(spark, sf, "events").select(F.col("user_id").alias("company_number"), F.col("event_type").alias("verdict"), F.when(F.col("event_id") % 3 == 0, "manual").otherwise("website").alias("source_type"), F.col("event_id").alias("classified_at"))
    return grouping.current_classification(events).select("company_number", "verdict", "source_type", "source_count", "distinct_verdicts", "sources_agreement")


SOURCE_AGREEMENT = """
WITH e AS (SELECT user_id AS company_number, event_type AS verdict, CASE WHEN event_id % 3 = 0 THEN 'manual' ELSE 'website' END AS source_type, event_id FROM events),
n AS (SELECT company_number, count(*) AS source_count, count(DISTINCT verdict) AS distinct_verdicts FROM e GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY company_number ORDER BY CASE source_type WHEN 'manual' THEN 1 ELSE 2 END, event_id DESC) AS k FROM e)
SELECT company_number, verdict, source_type, source_count, distinct_verdicts,
  CASE WHEN source_count >= 2 AND distinct_verdicts = 1 THEN 'agree' WHEN source_count >= 2 THEN 'disagree' ELSE 'single_source' END AS sources_agreement
FROM r JOIN n USING (company_number) WHERE k = 1
"""


def latest_per_key(spark, sf):
    return grouping.latest(load(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


LATEST = "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"


def first_primary(spark, sf):
    """First event of each user as primary, unless the user has a purchase."""
    events = load(spark, sf, "events")
    have = events.where("event_type = 'purchase' and user_id % 2 = 0").select("user_id", F.lit(True).alias("is_primary"))
    return grouping.primary_flags(events.where("event_type = 'view'"), have, "user_id", F.col("ts"), F.col("event_id")).select("event_id", "user_id", "is_primary")


FIRST_PRIMARY = """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0) AS is_primary
FROM events WHERE event_type = 'view'
"""


def score_ladders(spark, sf):
    """Every rung of the ladders, over customers."""
    c = load(spark, sf, "customer")
    three = [(F.col("c_custkey") % n == 0).alias(f"f{n}") for n in (2, 3, 5)]
    rows = c.select("c_custkey", _verdict().alias("verdict"), *three, (F.col("c_custkey") * 100003 % 60000000).cast("double").alias("revenue"), (F.col("c_custkey") % 30 + 40).alias("age"), (F.col("c_custkey") % 4).alias("over"))
    pts = {"class_pts": scores.class_points("verdict"), "service_pts": scores.service_points("f2", "f3", "f5"), "size_pts": scores.size_points("revenue"), "age_pts": scores.age_points("age", "over", F.col("over") == 3)}
    return rows.select("c_custkey", *(v.cast("long").alias(k) for k, v in pts.items()))


SCORE_LADDERS = """
WITH b AS (SELECT c_custkey, c_custkey % 2 = 0 AS h, c_custkey % 3 = 0 AS s, c_custkey % 5 = 0 AS r, CAST(c_custkey * 100003 % 60000000 AS DOUBLE) AS rev, c_custkey % 30 + 40 AS age, c_custkey % 4 AS ov FROM customer)
SELECT c_custkey, CAST(CASE c_custkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 3 ELSE 0 END AS BIGINT) AS class_pts,
  CAST(CASE WHEN h AND NOT s AND NOT r THEN 3 WHEN h AND s AND NOT r THEN 2 WHEN h AND r THEN 1 WHEN NOT h AND s AND NOT r THEN 1 ELSE 0 END AS BIGINT) AS service_pts,
  CAST(CASE WHEN rev BETWEEN 5000000 AND 25000000 THEN 2 WHEN rev BETWEEN 1000000 AND 4999999.999999 THEN 1 WHEN rev > 25000000 AND rev <= 50000000 THEN 1 ELSE 0 END AS BIGINT) AS size_pts,
  CAST(CASE WHEN ov = 3 THEN 3 WHEN ov >= 1 AND age >= 55 THEN 2 WHEN age >= 50 THEN 1 ELSE 0 END AS BIGINT) AS age_pts
FROM b
"""

QUERIES = {
    "tiered_scoring": (tiered_scoring, TIERED_SCORING),
    "best_match_window": (best_match_window, BEST_MATCH),
    "source_agreement": (source_agreement, SOURCE_AGREEMENT),
    "latest_per_key": (latest_per_key, LATEST),
    "first_primary": (first_primary, FIRST_PRIMARY),
    "score_ladders": (score_ladders, SCORE_LADDERS),
}
