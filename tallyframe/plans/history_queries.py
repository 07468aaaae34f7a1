"""Snapshots, gates, merges, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping, merges, snapshots
from ..sources.readers import bands_frame
from .tables import load

#: Head-count bands and their revenue estimates.
BANDS = """min_employees,max_employees,low_gbp,high_gbp,midpoint_gbp
1,4,50000,200000,125000
5,9,200000,400000,300000
10,19,400000,800000,600000
20,49,800000,2000000,1400000
50,99,2000000,4000000,3000000
100,249,4000000,10000000,7000000
250,499,10000000,25000000,17500000
500,999,25000000,50000000,37500000
1000,99999,50000000,100000000,75000000
"""


def _months(spark, sf):
    """Customers as two monthly snapshots: the first without every seventh, the second without every fiftieth, with changed balances."""
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return c.where("c_custkey % 7 <> 0"), c.where("c_custkey % 50 <> 1").withColumn("c_acctbal", F.col("c_acctbal") + 1)


def scd_upsert(spark, sf):
    first, second = _months(spark, sf)
    return snapshots.upsert(snapshots.bootstrap(first, "2024-01-01"), second, "c_custkey", "2024-02-01").drop("last_enriched_at")


SCD_UPSERT = """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 50 <> 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_custkey % 50 <> 1 AS is_active,
  CASE WHEN c_custkey % 7 <> 0 THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END AS first_scrape_date, CASE WHEN c_custkey % 50 <> 1 THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS last_scrape_date,
  CASE WHEN c_custkey % 50 = 1 THEN DATE '2024-02-01' END AS marked_inactive_scrape_date
FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 50 <> 1
"""


def upsert_gate(spark, sf):
    first, second = _months(spark, sf)
    return snapshots.gate_figures(snapshots.bootstrap(first, "2024-01-01"), second, "c_custkey").drop("dup_sample")


UPSERT_GATE = """
WITH a AS (SELECT count(*) AS old_total FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT count(*) AS new_total FROM customer WHERE c_custkey % 50 <> 1),
g AS (SELECT count(*) AS gone FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 50 = 1)
SELECT old_total, new_total, old_total AS currently_active, gone AS would_be_inactivated, CAST(0 AS BIGINT) AS dup_distinct, CAST(0 AS BIGINT) AS dup_excess, new_total - old_total AS row_delta,
  round(100.0 * abs(new_total - old_total) / old_total, 2) AS row_pct, round(100.0 * gone / old_total, 2) AS inactive_pct FROM a, b, g
"""


def dup_gate(spark, sf):
    return grouping.duplicate_keys(load(spark, sf, "lineitem"), "l_orderkey").select("dup_distinct", "dup_excess", F.array_join("dup_sample", ",").alias("dup_sample"))


DUP_GATE = """
WITH d AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS dup_distinct, CAST(sum(n - 1) AS BIGINT) AS dup_excess, (SELECT string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) FROM (SELECT l_orderkey FROM d ORDER BY l_orderkey LIMIT 5)) AS dup_sample FROM d
"""


def _sites(spark, sf):
    """Line items as a supplier's sites."""
    li = load(spark, sf, "lineitem").join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(
        F.col("l_suppkey").alias("provider_id"), F.col("p_type").alias("provider_name"), (F.col("l_linestatus") == "O").alias("is_active"), F.concat_ws("|", "p_brand", F.concat(F.lit(" "), F.col("l_returnflag"))).alias("service_types"),
        F.col("l_returnflag").alias("region"), F.concat(F.lit("SW"), (F.col("l_linenumber") % 3).cast("string"), F.lit("A 1AA")).alias("postcode"), F.when(F.col("p_size") % 2 == 0, F.col("l_returnflag")).alias("local_authority"),
        F.col("l_shipdate").cast("date").alias("first_scrape_date"), F.col("l_shipdate").cast("date").alias("last_scrape_date"), F.col("l_shipdate").cast("date").alias("marked_inactive_scrape_date"),
    )


def provider_rollup(spark, sf):
    out = grouping.rollup(_sites(spark, sf))
    return out.select(*(F.array_join(c, ",").alias(c) if c.endswith("_list") else F.col(c) for c in out.columns))


PROVIDER_ROLLUP = """
WITH s AS (SELECT l_suppkey AS provider_id, p_type, l_linestatus = 'O' AS act, p_brand, l_returnflag, p_size, 'SW' || (l_linenumber % 3) || 'A' AS prefix, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN part ON l_partkey = p_partkey),
v AS (SELECT DISTINCT provider_id, x FROM (SELECT provider_id, p_brand AS x FROM s WHERE act UNION ALL SELECT provider_id, l_returnflag FROM s WHERE act)),
sv AS (SELECT provider_id, string_agg(x, ',' ORDER BY x) AS l FROM v GROUP BY 1),
nm AS (SELECT provider_id, p_type, row_number() OVER (PARTITION BY provider_id ORDER BY count(*) DESC, p_type) AS k FROM s GROUP BY 1, 2)
SELECT s.provider_id, any_value(nm.p_type) AS provider_name, count(*) FILTER (WHERE act) AS active_location_count, count(*) AS total_location_count, coalesce(any_value(sv.l), '') AS service_types_list,
  coalesce(array_to_string(list_sort(list(DISTINCT l_returnflag) FILTER (WHERE act)), ','), '') AS regions_list, coalesce(array_to_string(list_sort(list(DISTINCT prefix) FILTER (WHERE act)), ','), '') AS postcode_prefixes_list,
  coalesce(array_to_string(list_sort(list(DISTINCT l_returnflag) FILTER (WHERE act AND p_size % 2 = 0)), ','), '') AS local_authorities_list, min(d) AS first_scrape_date, max(d) AS last_scrape_date, bool_or(act) AS is_active,
  CASE WHEN bool_or(act) THEN NULL ELSE max(d) END AS marked_inactive_scrape_date
FROM s LEFT JOIN sv USING (provider_id) JOIN nm ON nm.provider_id = s.provider_id AND nm.k = 1 GROUP BY s.provider_id
"""


def band_lookup(spark, sf):
    """Estimates from part sizes as head counts; a third has a filed figure."""
    rows = load(spark, sf, "part").select("p_partkey", (F.col("p_size") * 37 - 37).cast("int").alias("employee_count"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice")).alias("revenue"), F.when(F.col("p_partkey") % 3 == 0, "filed_accounts_ixbrl").alias("revenue_source"))
    return merges.estimate_fill(rows, bands_frame(spark, BANDS))


BAND_LOOKUP = """
WITH p AS (SELECT p_partkey, CAST(p_size * 37 - 37 AS INTEGER) AS employee_count, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS filed FROM part),
b(lo, hi, mid) AS (VALUES (1, 4, 125000.0::DOUBLE), (5, 9, 300000), (10, 19, 600000), (20, 49, 1400000), (50, 99, 3000000), (100, 249, 7000000), (250, 499, 17500000), (500, 999, 37500000), (1000, 99999, 75000000))
SELECT p_partkey, employee_count, coalesce(filed, mid) AS revenue, CASE WHEN filed IS NOT NULL THEN 'filed_accounts_ixbrl' WHEN mid IS NOT NULL THEN 'estimate_employee_band' END AS revenue_source
FROM p LEFT JOIN b ON employee_count BETWEEN lo AND hi
"""


def insert_ignore(spark, sf):
    """Orders of two halves that overlap: the first one's rows stay."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return merges.insert_ignore(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", -F.col("o_totalprice")), ["o_orderkey"])


INSERT_IGNORE = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice ELSE -o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0"


def insert_replace(spark, sf):
    """New rows win in their columns; a column that they lack keeps the old value."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return merges.insert_replace(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").select("o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice")), ["o_orderkey"])


INSERT_REPLACE = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0"

_FIGURES = {c: "double" for c in merges.FIGURES} | {"employee_count": "int", "filing_period_start": "date", "filing_period_end": "date", "filing_id": "string", "filing_format": "string", "filing_age_months": "int"}


def financial_merge(spark, sf):
    """Orders as stored figures and as staged filings of every state."""
    o = load(spark, sf, "orders")
    typed = lambda given: [given[c].cast(t).alias(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in _FIGURES.items()]
    key = F.col("o_orderkey")
    source = F.element_at(F.array(*map(F.lit, ["filed_accounts_ixbrl", "partial_ocr_no_pl", "no_recent_filing", "estimate_employee_band"])), (key % 4 + 1).cast("int"))
    stored = o.where("o_orderkey % 5 <> 0").select(key.alias("company_number"), *typed({"revenue": F.when(key % 4 != 2, F.col("o_totalprice")), "net_assets": F.lit(7.0), "filing_id": F.lit("a"), "filing_format": F.lit("pdf")}), source.alias("revenue_source"), F.lit(None).cast("timestamp").alias("last_enriched_at"))
    status = F.element_at(F.array(*map(F.lit, ["ok", "partial", "pdf_no_text_layer", "no_filing", "request_error"])), (F.floor(key / 4) % 5 + 1).cast("int"))
    staged = o.where("o_orderkey % 3 <> 0").select(
        key.alias("company_number"),
        *typed({"revenue": F.when(status == "ok", F.col("o_totalprice") * 2), "net_assets": F.when(status == "partial", 9.0), "filing_id": F.when(status != "no_filing", F.when(key % 2 == 0, "a").otherwise("b")), "filing_format": F.when(key % 7 < 3, "ixbrl").otherwise("ocr_pdf")}),
        status.alias("parse_status"), (key % 2 == 0).alias("profit_loss_exempt"), F.to_timestamp(F.lit("2024-01-01")).alias("fetched_at"),
    )
    return merges.merge_figures(stored, staged).select("company_number", "revenue", "revenue_source", "net_assets", "filing_id", "filing_format")


FINANCIAL_MERGE = """
WITH e AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 2 THEN o_totalprice END AS revenue, CAST(7 AS DOUBLE) AS net_assets, 'a' AS filing_id, 'pdf' AS filing_format,
    ['filed_accounts_ixbrl', 'partial_ocr_no_pl', 'no_recent_filing', 'estimate_employee_band'][1 + o_orderkey % 4] AS src FROM orders WHERE o_orderkey % 5 <> 0
), d0 AS (SELECT o_orderkey AS k, o_totalprice, ['ok', 'partial', 'pdf_no_text_layer', 'no_filing', 'request_error'][1 + (o_orderkey // 4) % 5] AS st FROM orders WHERE o_orderkey % 3 <> 0),
d AS (
  SELECT k, st, CASE WHEN st = 'ok' THEN o_totalprice * 2 END AS revenue, CASE WHEN st = 'partial' THEN CAST(9 AS DOUBLE) END AS net_assets,
    CASE WHEN st <> 'no_filing' THEN CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END END AS filing_id, CASE WHEN k % 7 < 3 THEN 'ixbrl' ELSE 'ocr_pdf' END AS filing_format, k % 2 = 0 AS exempt FROM d0
), j AS (
  SELECT coalesce(d.k, e.k) AS k, d.k IS NOT NULL AS staged, d.st, d.exempt, d.revenue AS dr, e.revenue AS er, d.net_assets AS dn, e.net_assets AS en, d.filing_id AS di, e.filing_id AS ei, d.filing_format AS df, e.filing_format AS ef, e.src,
    coalesce(d.st = 'pdf_no_text_layer' AND d.filing_id = e.filing_id AND e.src IN ('filed_accounts_ocr_pdf', 'partial_ocr_no_pl', 'filed_accounts_pdf_ocr'), FALSE) AS guarded
  FROM e FULL JOIN d ON e.k = d.k
), m AS (SELECT *, coalesce(staged AND di IS NOT NULL AND st <> 'request_error' AND NOT guarded, FALSE) AS rep, st = 'partial' AND exempt AS p1, st = 'partial' AND NOT exempt AND df = 'ocr_pdf' AS p2 FROM j)
SELECT k AS company_number, CASE WHEN rep THEN dr WHEN guarded OR NOT staged THEN er ELSE coalesce(dr, er) END AS revenue,
  CASE WHEN NOT staged OR guarded THEN src WHEN dr IS NOT NULL AND df = 'ixbrl' THEN 'filed_accounts_ixbrl' WHEN dr IS NOT NULL THEN 'filed_accounts_ocr_pdf' WHEN rep AND st = 'pdf_no_text_layer' THEN 'pdf_no_text_layer'
    WHEN rep AND p1 THEN 'partial_no_revenue' WHEN rep AND p2 THEN 'partial_ocr_no_pl' WHEN rep THEN NULL WHEN st = 'no_filing' AND er IS NULL AND src IS NULL THEN 'no_recent_filing' WHEN di IS NOT NULL AND src = 'no_recent_filing' THEN NULL ELSE src END AS revenue_source,
  CASE WHEN rep THEN dn WHEN guarded OR NOT staged THEN en ELSE coalesce(dn, en) END AS net_assets, CASE WHEN rep THEN di WHEN guarded OR NOT staged THEN ei ELSE coalesce(di, ei) END AS filing_id,
  CASE WHEN rep THEN df WHEN guarded OR NOT staged THEN ef ELSE coalesce(df, ef) END AS filing_format FROM m
"""


def staged_summary(spark, sf):
    o = load(spark, sf, "orders")
    pick = lambda items, n: F.element_at(F.array(*map(F.lit, items)), (F.col("o_orderkey") % n + 1).cast("int"))
    return merges.staged_summary(o.select(pick(["ok", "partial", "pdf_parse_partial", "no_filing", "request_error", "pdf_no_text_layer"], 6).alias("parse_status"), pick(["ixbrl", "PDF", "ocr_pdf", "x"], 4).alias("filing_format"), (F.col("o_orderkey") % 40).alias("filing_age_months")))


STAGED_SUMMARY = """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE k % 6 = 0) AS ok_count, count(*) FILTER (WHERE k % 6 IN (1, 2)) AS partial_count, count(*) FILTER (WHERE k % 4 = 0) AS ixbrl_count, count(*) FILTER (WHERE k % 4 IN (1, 2)) AS pdf_count,
  count(*) FILTER (WHERE k % 6 = 5) AS pdf_no_text_layer_count, count(*) FILTER (WHERE k % 6 = 3) AS no_filing_count, count(*) FILTER (WHERE k % 40 > 24) AS stale_count, count(*) FILTER (WHERE k % 6 = 4) AS error_count
FROM (SELECT o_orderkey AS k FROM orders)
"""


def incremental_targets(spark, sf):
    """Customers without an order since a day."""
    return merges.due(load(spark, sf, "customer"), load(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderdate", F.to_timestamp(F.lit("1999-06-01"))).select("c_custkey")


INCREMENTAL = "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE d IS NULL OR d < TIMESTAMP '1999-06-01'"


def match_persistence(spark, sf):
    """Suppliers' matches kept over a full rerun: user decisions stay."""
    s = load(spark, sf, "supplier")
    status = F.element_at(F.array(*map(F.lit, ["user_confirmed", "auto_confirmed", "user_rejected"])), (F.col("s_suppkey") % 3 + 1).cast("int"))
    old = s.where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("company_number"), F.col("s_suppkey").alias("provider_id"), status.alias("status"))
    new = s.select(F.col("s_nationkey").alias("company_number"), F.col("s_suppkey").alias("provider_id"), F.lit("fresh").alias("status"))
    scope = load(spark, sf, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("company_number"))
    return merges.keep_locked(old, new, ["company_number", "provider_id"], scope, "all")


MATCH_PERSISTENCE = """
WITH s AS (SELECT s_nationkey AS company_number, s_suppkey AS provider_id, ['user_confirmed', 'auto_confirmed', 'user_rejected'][1 + s_suppkey % 3] AS status FROM supplier),
stay AS (SELECT * FROM s WHERE provider_id % 2 = 0 AND (status LIKE 'user%' OR company_number >= 12))
SELECT * FROM stay UNION ALL SELECT company_number, provider_id, 'fresh' FROM s WHERE provider_id NOT IN (SELECT provider_id FROM stay)
"""

QUERIES = {
    "scd_upsert": (scd_upsert, SCD_UPSERT),
    "upsert_gate": (upsert_gate, UPSERT_GATE),
    "dup_gate": (dup_gate, DUP_GATE),
    "provider_rollup": (provider_rollup, PROVIDER_ROLLUP),
    "band_lookup": (band_lookup, BAND_LOOKUP),
    "insert_ignore": (insert_ignore, INSERT_IGNORE),
    "insert_replace": (insert_replace, INSERT_REPLACE),
    "financial_merge": (financial_merge, FINANCIAL_MERGE),
    "staged_summary": (staged_summary, STAGED_SUMMARY),
    "incremental_targets": (incremental_targets, INCREMENTAL),
    "match_persistence": (match_persistence, MATCH_PERSISTENCE),
}
