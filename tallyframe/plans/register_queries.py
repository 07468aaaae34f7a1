"""Register, places, profiles, checks and stored answers, over stand-ins made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, nested, pages, profiles, scores, sites
from ..operators import backfills, checks, facts, grouping, merges, places, reading, register, scoring, snapshots
from .tables import load


def _picked(key: str, values: list) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def _sql_picked(key: str, values: list) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"[{', '.join(map(quote, values))}][1 + {key} % {len(values)}]"


def _places(spark, sf):
    """Suppliers as places: name, services, region, authority, provider, postcode, activity."""
    s = load(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("location_id"), F.col("s_name").alias("name"), _picked("s_suppkey", SERVICES).alias("service_types"),
        F.concat(F.lit("Region "), (F.col("s_nationkey") % 5).cast("string")).alias("region"), F.concat(F.lit("Authority "), F.col("s_nationkey").cast("string")).alias("local_authority"),
        (F.col("s_suppkey") % 40).cast("string").alias("provider_id"), F.concat(F.lit("Provider "), (F.col("s_suppkey") % 40).cast("string")).alias("provider_name"),
        F.concat(F.lit("M"), (F.col("s_suppkey") % 30).cast("string"), F.lit(" 1AE")).alias("postcode"), (F.col("s_suppkey") % 4 != 0).alias("is_active"),
    )


SERVICES = ["Homecare agencies", "Residential homes|Nursing homes", "Supported living", None, "Homecare agencies|Supported living"]
_PLACES_SQL = f"""
SELECT CAST(s_suppkey AS VARCHAR) AS location_id, s_name AS name, {_sql_picked("s_suppkey", SERVICES)} AS service_types, 'Region ' || (s_nationkey % 5) AS region, 'Authority ' || s_nationkey AS local_authority,
  CAST(s_suppkey % 40 AS VARCHAR) AS provider_id, 'Provider ' || (s_suppkey % 40) AS provider_name, 'M' || (s_suppkey % 30) || ' 1AE' AS postcode, s_suppkey % 4 <> 0 AS is_active FROM supplier
"""


def location_filters(spark, sf):
    """All seven filters of a place together, and each alone, by a count."""
    p = _places(spark, sf)
    sets = {
        "every": {"name_contains": "supplier", "service_types": ["homecare", "supported"], "regions": ["Region 1", "Region 2"], "local_authorities": [f"Authority {k}" for k in range(20)], "provider_name_contains": "PROVIDER 1", "postcode_prefix": "M1", "is_active": True},
        "service": {"service_types": "nursing"},
        "region": {"regions": "Region 3"},
        "prefix": {"postcode_prefix": "M2"},
        "inactive": {"is_active": False},
        "none": {},
    }
    return p.agg(*(F.count_if(places.location_filter(**f)).alias(name) for name, f in sets.items()))


LOCATION_FILTERS = f"""
SELECT count(*) FILTER (WHERE lower(name) LIKE '%supplier%' AND (lower(service_types) LIKE '%homecare%' OR lower(service_types) LIKE '%supported%') AND region IN ('Region 1', 'Region 2')
    AND CAST(substr(local_authority, 11) AS INT) < 20 AND lower(provider_name) LIKE '%provider 1%' AND starts_with(postcode, 'M1') AND is_active) AS "every",
  count(*) FILTER (WHERE lower(service_types) LIKE '%nursing%') AS service, count(*) FILTER (WHERE region = 'Region 3') AS region, count(*) FILTER (WHERE starts_with(postcode, 'M2')) AS prefix,
  count(*) FILTER (WHERE NOT is_active) AS inactive, count(*) AS "none" FROM ({_PLACES_SQL})
"""


def provider_filters(spark, sf):
    """A rollup of the places, filtered on its lists and counts."""
    p = _places(spark, sf).withColumns({"first_scrape_date": F.lit(None).cast("date"), "last_scrape_date": F.lit(None).cast("date"), "marked_inactive_scrape_date": F.lit(None).cast("date")})
    rows = grouping.rollup(p).where(places.provider_filter("provider", ["Homecare agencies", "Nursing homes"], ["Region 0", "Region 4"], None, True, 1, 200))
    return rows.select("provider_id", "provider_name", F.col("active_location_count").cast("long").alias("n_active"), F.array_join("service_types_list", ";").alias("services"), F.array_join("postcode_prefixes_list", ";").alias("prefixes"))


PROVIDER_FILTERS = f"""
WITH p AS ({_PLACES_SQL}), a AS (SELECT * FROM p WHERE is_active),
v AS (SELECT provider_id, string_agg(DISTINCT x, ';' ORDER BY x) AS services, list(DISTINCT x) AS l FROM (SELECT provider_id, unnest(string_split(service_types, '|')) AS x FROM a) GROUP BY 1),
r AS (SELECT provider_id, max(provider_name) AS provider_name, count(*) FILTER (WHERE is_active) AS n_active, list(DISTINCT region) FILTER (WHERE is_active) AS regions,
  string_agg(DISTINCT regexp_extract(postcode, '^([A-Z]{{1,2}}[0-9][A-Z0-9]?)', 1), ';' ORDER BY regexp_extract(postcode, '^([A-Z]{{1,2}}[0-9][A-Z0-9]?)', 1)) FILTER (WHERE is_active) AS prefixes FROM p GROUP BY 1)
SELECT provider_id, provider_name, n_active, services, prefixes FROM r JOIN v USING (provider_id) WHERE list_has_any(l, ['Homecare agencies', 'Nursing homes']) AND list_has_any(regions, ['Region 0', 'Region 4']) AND n_active BETWEEN 1 AND 200
"""


def listed_places(spark, sf):
    """Listed places joined to places and to customers as companies by number; only those that name a number."""
    p = _places(spark, sf)
    listed = p.select("location_id", F.when(F.col("location_id").cast("int") % 3 != 0, F.col("location_id").cast("long")).alias("provider_companies_house_number"))
    companies = load(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("company_number"), F.col("c_name").alias("company_name"))
    return places.with_companies(listed, p, companies, True, is_active=True, regions=["Region 1", "Region 2"]).select("location_id", "name", "provider_companies_house_number", "company_name")


LISTED_PLACES = f"""
WITH p AS ({_PLACES_SQL}) SELECT location_id, name, CAST(location_id AS BIGINT) AS provider_companies_house_number, c_name AS company_name
FROM p LEFT JOIN customer ON CAST(location_id AS BIGINT) = c_custkey * 2 WHERE CAST(location_id AS INT) % 3 <> 0 AND is_active AND region IN ('Region 1', 'Region 2')
"""


def in_scope(spark, sf):
    """Active providers with a place of a relevant service, each once; the flag filter on top."""
    p = _places(spark, sf)
    providers = p.groupBy("provider_id").agg(F.bool_or("is_active").alias("is_active"), F.count_if(F.col("service_types").isNull()).alias("directors_over_60"))
    found = places.in_scope(providers, p, F.col("service_types").contains("Nursing") | F.col("service_types").contains("Supported"))
    return found.where(reading.both(places.over_60_filter(True), places.over_60_filter(False))).select("provider_id", "directors_over_60")


IN_SCOPE = f"""
WITH p AS ({_PLACES_SQL}), g AS (SELECT provider_id, bool_or(is_active) AS up, count(*) FILTER (WHERE service_types IS NULL) AS directors_over_60 FROM p GROUP BY 1)
SELECT provider_id, directors_over_60 FROM g WHERE up AND directors_over_60 > 0 AND EXISTS (SELECT 1 FROM p WHERE p.provider_id = g.provider_id AND (service_types LIKE '%Nursing%' OR service_types LIKE '%Supported%'))
"""


def two_keys(spark, sf):
    """Customers looked up among orders' customers by number, else by name and postcode."""
    c = load(spark, sf, "customer")
    post = F.concat(F.lit("m"), (F.col("c_custkey") % 50).cast("string"), F.lit(" 1ae"))
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).alias("company_number"), F.concat(F.lit("The "), F.col("c_name"), F.lit(" LTD")).alias("provider_name"), post.alias("postcode"))
    known = c.where("c_acctbal > 0").select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).alias("company_number"), F.col("c_name").alias("provider_name"), F.upper(post).alias("postcode"), F.concat(F.lit("Tier "), (F.col("c_custkey") % 4).cast("string")).alias("tier"))
    return places.by_number_or_place(rows, known, "tier").select("c_custkey", "tier", "found")


TWO_KEYS = """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'Tier ' || (c_custkey % 4) END AS tier, coalesce(c_acctbal > 0, FALSE) AS found FROM customer
"""


def register_projection(spark, sf):
    """Customers as rows of a bulk file, projected to the register's 60 columns; a part of them, as text."""
    c = load(spark, sf, "customer")
    n = F.col("c_custkey")
    raw = {name: F.lit(None).cast("string") for name in (*register.AS_WRITTEN.values(), *register.TRIMMED.values(), *register.DATES.values(), *register.NUMBERS.values())}
    raw |= {f"SICCode.SicText_{k}": F.lit(None).cast("string") for k in range(1, 5)} | {f"PreviousName_{k}.{p}": F.lit(None).cast("string") for k in range(1, 11) for p in ("CONDATE", "CompanyName")}
    raw |= {
        "CompanyNumber": F.lpad(n.cast("string"), 8, "0"),
        "CompanyName": F.col("c_name"),
        "SICCode.SicText_1": _picked("c_custkey", ["88100 - Social work", " 87300 - Residential", "None Supplied", ""]),
        "RegAddress.CareOf": _picked("c_custkey", ["", "  ", " A B ", None]),
        "RegAddress.AddressLine1": F.concat(F.lit(" "), n.cast("string"), F.lit(" High St ")),
        "RegAddress.PostTown": F.col("c_mktsegment"),
        "RegAddress.PostCode": F.lit(" M1 1AE "),
        "IncorporationDate": _picked("c_custkey", ["31/12/1999", "2001-02-03", "99/99/2000", "", None]),
        "Accounts.AccountRefDay": _picked("c_custkey", ["31", " 30", "x", None]),
        "Mortgages.NumMortCharges": n.cast("string"),
        "PreviousName_10.CompanyName": F.upper("c_name"),
    }
    out = register.register_rows(c.select(*(v.alias(k) for k, v in raw.items())))
    return out.select("company_number", "company_name", "sic_code_1", "sic_text_1", "address_care_of", "registered_address", "postcode", F.col("incorporation_date").cast("string").alias("incorporation_date"), F.col("accounts_ref_day").cast("long").alias("ref_day"), F.col("num_mort_charges").cast("long").alias("charges"), "prev_name_10", F.lit(len(out.columns)).cast("long").alias("n_columns"))


REGISTER_PROJECTION = f"""
WITH r AS (SELECT *, {_sql_picked("c_custkey", ["88100 - Social work", " 87300 - Residential", "None Supplied", ""])} AS sic, {_sql_picked("c_custkey", ["", "  ", " A B ", None])} AS care, {_sql_picked("c_custkey", ["31/12/1999", "2001-02-03", "99/99/2000", "", None])} AS d, {_sql_picked("c_custkey", ["31", " 30", "x", None])} AS rd FROM customer)
SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS company_number, c_name AS company_name, nullif(regexp_extract(sic, '^\\s*(\\d+)', 1), '') AS sic_code_1, sic AS sic_text_1, trim(care) AS address_care_of,
  concat_ws(', ', nullif(trim(care), ''), c_custkey || ' High St', c_mktsegment) AS registered_address, 'M1 1AE' AS postcode,
  CAST(coalesce(CAST(try_strptime(d, '%d/%m/%Y') AS DATE), TRY_CAST(d AS DATE)) AS VARCHAR) AS incorporation_date, TRY_CAST(rd AS BIGINT) AS ref_day, c_custkey AS charges, upper(c_name) AS prev_name_10, 60 AS n_columns FROM r
"""


def profile_update(spark, sf):
    """Answers for every second customer over stored rows of two sources; new companies come in."""
    c = load(spark, sf, "customer")
    number = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    stored = c.where("c_custkey % 5 <> 0").select(
        number.alias("company_number"), F.col("c_name").alias("company_name"), F.lit("Active").alias("company_status"), F.lit("Old").alias("company_type"), F.col("c_mktsegment").alias("uri"), F.lit("LS1").alias("postcode"),
        F.when(F.col("c_custkey") % 3 == 0, "api").otherwise("bulk").alias("record_source"), F.lit("2026-01-01").cast("date").alias("last_scrape_date"),
    )
    status = _picked("c_custkey", ["active", "dissolved", "receivership", "closed", "in-some-state"])
    answers = c.where("c_custkey % 2 = 0").select(F.to_json(F.struct(number.alias("company_number"), F.upper("c_name").alias("company_name"), status.alias("company_status"), F.lit("ltd").alias("type"))).alias("raw_json"))
    out = register.apply_profiles(stored, answers, "2026-05-01")
    return out.select("company_number", "company_name", "company_status", "company_type", "uri", "postcode", "record_source", F.col("last_scrape_date").cast("string").alias("seen"))


PROFILE_UPDATE = f"""
SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS company_number, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS company_name,
  CASE WHEN c_custkey % 2 = 0 THEN {_sql_picked("c_custkey", ["Active", "Dissolved", "RECEIVERSHIP", "Closed", "In some state"])} ELSE 'Active' END AS company_status, CASE WHEN c_custkey % 2 = 0 THEN 'Private Limited Company' ELSE 'Old' END AS company_type,
  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS uri, CASE WHEN c_custkey % 2 = 1 THEN 'LS1' END AS postcode, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 'api' ELSE 'bulk' END AS record_source,
  CASE WHEN c_custkey % 2 = 0 THEN '2026-05-01' ELSE '2026-01-01' END AS seen FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 2 = 0
"""


def fetch_plan(spark, sf):
    """Which of the wanted companies have to be asked for again."""
    c = load(spark, sf, "customer").withColumn("company_number", F.col("c_custkey").cast("string"))
    stored = c.where("c_custkey % 4 <> 0").select("company_number", F.when(F.col("c_custkey") % 3 == 0, "api").otherwise("bulk").alias("record_source"), F.when(F.col("c_custkey") % 7 != 0, F.date_sub(F.lit("2026-05-01").cast("date"), (F.col("c_custkey") % 60).cast("int"))).alias("last_scrape_date"))
    return register.to_fetch(c, stored, F.lit("2026-05-01").cast("date"), True)


FETCH_PLAN = """
SELECT CAST(c_custkey AS VARCHAR) AS company_number, CASE WHEN c_custkey % 4 = 0 THEN 'new' WHEN c_custkey % 7 = 0 OR c_custkey % 3 = 0 OR c_custkey % 60 > 30 THEN 'again' ELSE 'present' END AS state FROM customer
"""


def report_rows(spark, sf):
    """Report rows of listed customers: companies with and without figures, unknown numbers and what isn't a number."""
    c = load(spark, sf, "customer")
    number = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    listed = c.select(F.col("c_custkey").alias("position"), F.concat(F.lit("no. "), F.col("c_custkey").cast("string")).alias("written"), F.when(F.col("c_custkey") % 11 != 0, number).alias("company_number"))
    companies = c.where("c_custkey % 7 <> 0").select(number.alias("company_number"), F.col("c_name").alias("company_name"), F.lit(None).cast("date").alias("incorporation_date"), F.lit("Active").alias("company_status"))
    source = _picked("c_custkey", ["no_recent_filing", "pdf_no_text_layer", "employee_band_lookup", None, "filed_accounts_pdf", None])
    figures = c.where("c_custkey % 3 <> 0").select(
        number.alias("company_number"), F.when(F.col("c_custkey") % 5 != 0, "[1960]").alias("directors_dob_years"), (F.col("c_custkey") % 4).alias("total_active_directors"), F.when(F.col("c_custkey") % 4 != 1, F.lit(50)).alias("avg_director_age"), source.alias("revenue_source"),
        F.when(F.col("c_custkey") % 2 == 0, "f").alias("filing_id"), F.lit("pdf").alias("filing_format"), F.when(F.col("c_custkey") % 8 < 4, F.col("c_custkey").cast("double")).alias("revenue"), F.when(F.col("c_custkey") % 9 == 1, F.lit(3)).alias("employee_count"),
    )
    out = register.report_rows(listed, companies, figures, 2026)
    return out.select(F.col("Company Number").alias("company_number"), F.col("Company Name").alias("company_name"), F.col("Revenue").alias("revenue"), F.col("Accounts Source").alias("accounts_source"), F.col("Notes").alias("notes"), F.lit(len(out.columns)).cast("long").alias("n_columns"))


REPORT_ROWS = f"""
WITH c AS (SELECT *, c_custkey % 3 <> 0 AS has, {_sql_picked("c_custkey", ["no_recent_filing", "pdf_no_text_layer", "employee_band_lookup", None, "filed_accounts_pdf", None])} AS src, CASE WHEN c_custkey % 2 = 0 THEN 'f' END AS f,
  CASE WHEN c_custkey % 8 < 4 AND {_sql_picked("c_custkey", [1, 1, 0, 1, 1, 1])} = 1 THEN CAST(c_custkey AS DOUBLE) END AS shown, CASE WHEN c_custkey % 8 < 4 THEN c_custkey END AS rev, CASE WHEN c_custkey % 9 = 1 THEN 3 END AS emp FROM customer),
n AS (SELECT *, CASE WHEN NOT has OR c_custkey % 5 = 0 THEN 'Directors not fetched' WHEN c_custkey % 4 = 0 THEN 'No active directors' WHEN c_custkey % 4 = 1 THEN 'No director dates of birth' END AS a,
  CASE WHEN NOT has THEN 'Accounts not fetched' WHEN src = 'no_recent_filing' THEN 'No accounts filed' WHEN src = 'pdf_no_text_layer' THEN 'Scanned PDF accounts - figures pending OCR' WHEN f IS NULL THEN 'Accounts not fetched'
    WHEN src IS NULL AND rev IS NULL AND emp IS NULL THEN 'Accounts found but could not be read' WHEN shown IS NULL THEN 'Revenue not in filed accounts' END AS b FROM c)
SELECT CASE WHEN c_custkey % 11 = 0 THEN 'no. ' || c_custkey ELSE lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS company_number, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 THEN c_name END AS company_name,
  CASE WHEN c_custkey % 11 <> 0 AND has THEN shown END AS revenue, CASE WHEN c_custkey % 11 <> 0 AND has THEN 'PDF' END AS accounts_source,
  CASE WHEN c_custkey % 11 = 0 THEN '{register.NOT_VALID}' WHEN c_custkey % 7 = 0 THEN '{register.NOT_FOUND}' ELSE nullif(concat_ws('; ', a, b), '') END AS notes, 24 AS n_columns FROM n
"""


def independence(spark, sf):
    """Independence of suppliers by owner, charity number, name, brand and type, and the tier of a gap."""
    s = load(spark, sf, "supplier")
    k = "s_suppkey"
    owner, name, kind = _picked(k, ["Organisation", "Individual", None, "Organisation"]), _picked(k, ["Oak Care", "Oak Trust", "Oak Care", "Oak Care", "NHS Oak"]), _picked(k, [*profiles.INCLUDED_TYPES, "Royal Charter Company", "PRI/LBG/NSC (x)", "Limited Partnership", "", "Odd"])
    decision, reason = profiles.independence(name, owner, F.when(F.col(k) % 13 == 0, F.lit("99")), F.when(F.col(k) % 17 == 0, F.lit("Chain")), kind)
    tier, why = profiles.gap_tier(_picked(k, ["Domiciliary Care", "Domiciliary Care + Supported Living", "Other"]), F.when(F.col(k) % 4 != 0, F.col(k) % 30 + 40), F.when(F.col(k) % 5 == 0, F.lit(1)))
    return s.select(k, decision.alias("decision"), reason.alias("reason"), tier.alias("tier"), F.length(why).cast("long").alias("told"))


INDEPENDENCE = f"""
WITH s AS (SELECT s_suppkey AS k, {_sql_picked("s_suppkey", ["Organisation", "Individual", None, "Organisation"])} AS o, {_sql_picked("s_suppkey", ["Oak Care", "Oak Trust", "Oak Care", "Oak Care", "NHS Oak"])} AS n,
  {_sql_picked("s_suppkey", [*profiles.INCLUDED_TYPES, "Royal Charter Company", "PRI/LBG/NSC (x)", "Limited Partnership", "", "Odd"])} AS t, {_sql_picked("s_suppkey", ["Domiciliary Care", "Domiciliary Care + Supported Living", "Other"])} AS c, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 30 + 40 END AS age FROM supplier),
d AS (SELECT *, CASE WHEN o = 'Individual' THEN 'ownership_type=Individual' WHEN k % 13 = 0 THEN 'has charity_number=99' WHEN n = 'Oak Trust' THEN 'name contains ''trust''' WHEN n = 'NHS Oak' THEN 'name contains ''nhs''' WHEN k % 17 = 0 THEN 'franchise/chain brand=Chain' END AS x, coalesce(age >= 60, FALSE) OR k % 5 = 0 AS aged FROM s)
SELECT k AS s_suppkey, CASE WHEN x IS NOT NULL THEN 'exclude' WHEN t IN ('Private Limited Company', 'Limited Liability Partnership') THEN 'include' WHEN t IN ('Royal Charter Company', 'PRI/LBG/NSC (x)') THEN 'exclude' ELSE 'review' END AS decision,
  coalesce(x, CASE WHEN t = '' THEN 'no company_type available' WHEN t = 'PRI/LBG/NSC (x)' THEN 'company_type starts with PRI/LBG/NSC' WHEN t = 'Limited Partnership' THEN 'company_type=Limited Partnership (rare commercial form)' WHEN t = 'Odd' THEN 'unknown company_type=Odd' ELSE 'company_type=' || t END) AS reason,
  CASE WHEN c = 'Other' THEN 'Excluded' WHEN c LIKE '%Living' THEN 'Tier 3' WHEN aged THEN 'Tier 1' ELSE 'Tier 2' END AS tier,
  length(CASE WHEN c = 'Other' THEN 'unexpected classification' WHEN c LIKE '%Living' THEN 'Domiciliary Care + Supported Living → Tier 3' WHEN aged THEN 'Domiciliary Care, oldest director=' || coalesce(CAST(age AS VARCHAR), 'None') || ' (≥60)' ELSE 'Domiciliary Care, oldest director=' || coalesce(CAST(age AS VARCHAR), 'None') || ' (<60 or unknown)' END) AS told FROM d
"""


def suspicion_rules(spark, sf):
    """Orders as filings: every structural rule, and the outliers of the logs and ratios over all rows."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    f = o.select(
        "o_orderkey", F.when(k % 97 == 0, F.lit(2e9)).when(k % 11 != 0, F.col("o_totalprice")).alias("revenue"), F.when(k % 7 != 0, (k % 40) - 1).cast("int").alias("employee_count"), (F.col("o_totalprice") * F.when(k % 50 == 0, 0.01).otherwise(0.8)).alias("total_assets"),
        (F.col("o_totalprice") * F.when(k % 20 == 0, 0.9).otherwise(0.3)).alias("net_assets"), (F.col("o_totalprice") * F.when(k % 13 == 0, 1.5).otherwise(0.5)).alias("gross_profit"), F.lit(None).cast("double").alias("profit_before_tax"), F.lit(None).cast("double").alias("profit_after_tax"), F.lit(None).cast("double").alias("net_current_assets"),
        F.lit("2024-01-01").cast("date").alias("filing_period_start"), F.date_add(F.lit("2024-01-01").cast("date"), ((k % 6) * 120 - 10).cast("int")).alias("filing_period_end"),
    )
    out = checks.scored_filings(f)
    return out.select("o_orderkey", F.col("suspicion_score").cast("long").alias("score"), F.col("n_signals").cast("long").alias("n_signals"), checks.score_bucket("suspicion_score").alias("bucket"))


SUSPICION_RULES = """
WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 0 THEN 2e9 WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS rev, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 40 - 1 END AS emp, o_totalprice * CASE WHEN o_orderkey % 50 = 0 THEN 0.01 ELSE 0.8 END AS ta,
  o_totalprice * CASE WHEN o_orderkey % 20 = 0 THEN 0.9 ELSE 0.3 END AS na, o_totalprice * CASE WHEN o_orderkey % 13 = 0 THEN 1.5 ELSE 0.5 END AS gp, (o_orderkey % 6) * 120 - 10 AS days FROM orders),
r AS (SELECT *, CASE WHEN rev > 0 AND emp > 0 THEN rev / emp END AS re, CASE WHEN rev > 0 AND ta > 0 THEN rev / ta END AS ra FROM f),
l AS (UNPIVOT (SELECT k, CAST(rev AS DOUBLE) AS rev, CAST(emp AS DOUBLE) AS emp, CAST(ta AS DOUBLE) AS ta, CAST(na AS DOUBLE) AS na, CAST(gp AS DOUBLE) AS gp, CAST(re AS DOUBLE) AS re, CAST(ra AS DOUBLE) AS ra FROM r) ON rev, emp, ta, na, gp, re, ra INTO NAME c VALUE v),
p AS (SELECT k, c, ln(v) AS x FROM l WHERE v > 0), m AS (SELECT c, median(x) AS mid FROM p GROUP BY 1), d AS (SELECT p.c, median(abs(x - mid)) AS mad FROM p JOIN m ON p.c = m.c GROUP BY 1),
z AS (SELECT k, sum(CASE WHEN p.c IN ('re', 'ra') THEN 4 ELSE 2 END) AS w, count(*) AS n FROM p JOIN m ON p.c = m.c JOIN d ON p.c = d.c WHERE abs(x - mid) / (CASE WHEN mad = 0 THEN 1e-9 ELSE mad END * 1.4826) > 3.5 GROUP BY 1),
s AS (SELECT k, coalesce(ta < na, FALSE)::INT + (days <= 0)::INT + coalesce(emp < 0, FALSE)::INT + coalesce(gp > rev, FALSE)::INT + (days > 0 AND NOT days BETWEEN 180 AND 545)::INT + coalesce(rev > 1000000000, FALSE)::INT + coalesce(emp > 5 AND rev > 0 AND rev / emp > 1000000, FALSE)::INT
  + coalesce(rev > 100000000 AND emp > 0 AND emp < 200, FALSE)::INT + coalesce(ta > 0 AND rev > 10 * ta, FALSE)::INT AS h FROM r),
t AS (SELECT s.k, 10 * h + coalesce(w, 0) AS score, h + coalesce(n, 0) AS n_signals FROM s LEFT JOIN z ON s.k = z.k)
SELECT k AS o_orderkey, CAST(score AS BIGINT) AS score, CAST(n_signals AS BIGINT) AS n_signals, CASE WHEN score = 0 THEN '0 (clean)' WHEN score < 5 THEN '1-4' WHEN score < 10 THEN '5-9' WHEN score < 15 THEN '10-14' WHEN score < 20 THEN '15-19' ELSE '20+' END AS bucket FROM t
"""


def director_backfill(spark, sf):
    """Events as stored officer answers: the latest good one of each user, over stored figures."""
    e = load(spark, sf, "events")
    officer = F.struct(F.concat(F.lit("P"), F.col("event_id").cast("string")).alias("name"), F.when(F.col("event_id") % 4 == 0, "secretary").otherwise("director").alias("officer_role"), F.struct((F.col("event_id") % 40 + 1950).cast("int").alias("year")).alias("date_of_birth"))
    answers = e.select(F.lit("ch_directors").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("response_id"), F.when(F.col("event_id") % 5 == 0, 500).otherwise(200).alias("http_status"), F.to_json(F.array(officer)).alias("raw_json"))
    stored = e.where("user_id % 2 = 0").select(F.lpad(F.col("user_id").cast("string"), 8, "0").alias("company_number"), F.lit(7.0).alias("revenue")).distinct()
    out = backfills.directors(answers, stored, 2026, "2026-05-01 00:00:00")
    long = lambda c: F.col(c).cast("long").alias(c)
    return out.select("company_number", "revenue", long("total_active_directors"), long("avg_director_age"), long("max_director_age"), long("directors_over_60"), "all_directors_60_plus", "directors_dob_years")


DIRECTOR_BACKFILL = """
WITH l AS (SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_id % 5 <> 0) WHERE k = 1),
n AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS company_number, event_id % 4 <> 0 AS d, 1950 + event_id % 40 AS y FROM l), s AS (SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 8, '0') AS company_number FROM events WHERE user_id % 2 = 0)
SELECT coalesce(n.company_number, s.company_number) AS company_number, CASE WHEN s.company_number IS NOT NULL THEN 7.0::DOUBLE END AS revenue, CASE WHEN d THEN 1 WHEN NOT d THEN 0 END::BIGINT AS total_active_directors, CASE WHEN d THEN 2026 - y END::BIGINT AS avg_director_age,
  CASE WHEN d THEN 2026 - y END::BIGINT AS max_director_age, CASE WHEN d THEN (2026 - y >= 60)::BIGINT WHEN NOT d THEN 0 END AS directors_over_60, CASE WHEN d THEN 2026 - y >= 60 WHEN NOT d THEN FALSE END AS all_directors_60_plus,
  CASE WHEN d THEN '[' || y || ']' WHEN NOT d THEN '[]' END AS directors_dob_years FROM n FULL JOIN s ON n.company_number = s.company_number
"""


def stored_flags(spark, sf):
    """Parts as stored rows: names of the flags that are a yes, and key-question ratings, read again."""
    p = load(spark, sf, "part")
    raw = F.to_json(F.create_map(F.lit("Band A"), _picked("p_partkey", ["Y", "N", "yes", ""]), F.lit("Band B"), _picked("p_partkey", ["", "true", "1"])))
    answer = F.concat(F.lit('{"overall": {"keyQuestionRatings": [{"name": "Safe", "rating": "'), _picked("p_partkey", ["Good", "Outstanding"]), F.lit('"}, {"name": "Well-led", "rating": "R'), (F.col("p_partkey") % 3).cast("string"), F.lit('"}]}}'))
    rows = backfills.row_flags(p.select("p_partkey", raw.alias("raw_row"), answer.alias("current_ratings")), {"bands": {"Older people": "Band B", "Children": "Band A", "None": "Band C"}})
    return backfills.key_question_ratings(rows).select("p_partkey", "bands", "rating_safe", "rating_caring", "rating_well_led")


STORED_FLAGS = """
SELECT p_partkey, '[' || concat_ws(',', CASE WHEN p_partkey % 3 <> 0 THEN '"Older people"' END, CASE WHEN p_partkey % 4 IN (0, 2) THEN '"Children"' END) || ']' AS bands, CASE WHEN p_partkey % 2 = 0 THEN 'Good' ELSE 'Outstanding' END AS rating_safe, CAST(NULL AS VARCHAR) AS rating_caring, 'R' || (p_partkey % 3) AS rating_well_led FROM part
"""


def grouped_runs(spark, sf):
    """Each customer's orders in order of date and key, as one row."""
    o = load(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return grouping.grouped_runs(o, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("keys"))


GROUPED_RUNS = "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1"


def page_parts(spark, sf):
    """A page of customers with the total beside it, the count of a limited read, and the percent that is filled."""
    c = load(spark, sf, "customer").withColumn("text", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")))
    rows, total = reading.page_and_total(c, reading.sort_keys({"name": F.col("c_name")}, "nothing", "name", False, "c_custkey"), 2, 10)
    limited = reading.limited(c, 17).count()
    return rows.select("c_custkey", F.lit(total).cast("long").alias("total"), F.lit(limited).cast("long").alias("limited"))


PAGE_PARTS = "SELECT c_custkey, (SELECT count(*) FROM customer) AS total, 17 AS limited FROM customer ORDER BY c_name, c_custkey LIMIT 10 OFFSET 10"


def numbered(spark, sf):
    """Surrogate ids of new rows after the largest one in use, and the next id."""
    o = load(spark, sf, "orders")
    out = grouping.with_ids(o.select("o_orderkey", "o_orderdate"), o.where("o_orderkey < 100").select(F.col("o_orderkey").alias("id")), "id", F.col("o_orderdate"), F.col("o_orderkey"))
    return out.join(grouping.next_id(o, "o_orderkey")).select("o_orderkey", F.col("id").cast("long").alias("id"), F.col("next_id").cast("long").alias("next_id"))


NUMBERED = "SELECT o_orderkey, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 100) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, (SELECT max(o_orderkey) + 1 FROM orders) AS next_id FROM orders"


def text_values(spark, sf):
    """Numbers of scripts, head counts, flags as lists, sorted JSON, account figures and totals, over customers."""
    c = load(spark, sf, "customer")
    k = "c_custkey"
    loose = _picked(k, ["123.0", " 99 ", "nan", "SC12", None, "12345678"])
    heads = _picked(k, ["12.7", "-3", "1000000", "x", None])
    flags = codes.flagged_names({"b": F.col(k) % 2 == 0, "a": F.col(k) % 3 == 0})
    total = codes.sum_unless_null(F.when(F.col(k) % 2 == 0, F.lit(1.5)), F.when(F.col(k) % 3 == 0, F.lit(2.0)))
    status = scores.parse_status({"revenue": F.when(F.col(k) % 2 == 0, 1), "staff": F.when(F.col(k) % 3 == 0, 1)}, F.col(k) % 10 == 6)
    prime = scores.prime_target(F.col(k) % 30 + 45, (F.col(k) % 9).cast("double"), F.when(F.col(k) % 4 != 0, F.col(k) % 50))
    filed = scores.filed_only("c_acctbal", F.when(F.col(k) % 2 == 0, "estimate_employee_band"))
    ages = nested.over_age(F.array(F.lit(1950), (F.col(k) % 60 + 1940).cast("int")), 60, 2026)
    words = sites.name_tokens(F.concat("c_name", F.lit(" the Care LTD ab Oak oak")))
    out = c.withColumns({"z": F.col(k) % 2, "a": F.col("c_mktsegment"), "m": F.lit(None).cast("string")})
    return out.select(k, codes.loose_number(loose).alias("number"), codes.headcount(heads).cast("long").alias("heads"), F.array_join(flags, ",").alias("flags"), codes.sorted_json("z", "m", "a").alias("json"), total.alias("total"), status.alias("status"), prime.alias("prime"), filed.alias("filed"), ages[0].cast("long").alias("n_over"), ages[1].alias("all_over"), F.array_join(words, ",").alias("words"))


TEXT_VALUES = f"""
WITH c AS (SELECT *, c_custkey AS k FROM customer)
SELECT k AS c_custkey, {_sql_picked("k", ["00000123", "00000099", None, "SC12", None, "12345678"])} AS number, {_sql_picked("k", [12, 3, None, None, None])} AS heads,
  concat_ws(',', CASE WHEN k % 2 = 0 THEN 'b' END, CASE WHEN k % 3 = 0 THEN 'a' END) AS flags, '{{"a":"' || c_mktsegment || '","m":null,"z":' || (k % 2) || '}}' AS json,
  CASE WHEN k % 6 = 0 THEN 3.5 WHEN k % 2 = 0 THEN 1.5 WHEN k % 3 = 0 THEN 2.0 END::DOUBLE AS total, CASE WHEN k % 10 = 6 OR (k % 2 <> 0 AND k % 3 <> 0) THEN 'error' WHEN k % 6 = 0 THEN 'ok' ELSE 'partial' END AS status,
  coalesce(k % 30 + 45 >= 58 AND k % 9 > 5 AND CASE WHEN k % 4 <> 0 THEN k % 50 END > 20, FALSE) AS prime, CASE WHEN k % 2 <> 0 THEN c_acctbal END AS filed,
  1 + (2026 - (k % 60 + 1940) >= 60)::BIGINT AS n_over, 2026 - (k % 60 + 1940) >= 60 AS all_over, lower(replace(c_name, '#', '')) || ',oak' AS words FROM c
"""


def fact_parts(spark, sf):
    """Balance-sheet values, period bounds, staff and signs, over line items as facts."""
    li = load(spark, sf, "lineitem")
    day = F.col("l_shipdate").cast("date")
    f = li.select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", "NetAssets").when(F.col("l_returnflag") == "A", "Turnover").otherwise("Debtors").alias("name"), F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_returnflag") != "A", day).alias("instant"), F.when(F.col("l_returnflag") == "A", F.date_sub(day, 364)).alias("startdate"), F.when(F.col("l_returnflag") == "A", day).alias("enddate"), F.when(F.col("l_linestatus") == "O", F.array(F.lit("Group"))).otherwise(F.array().cast("array<string>")).alias("members"),
    )
    held = facts.at_balance_sheet(f, ["NetAssets", "Debtors"], ["Company"]).select("doc_id", F.col("name").alias("held_name"), facts.liability(-F.col("value")).alias("held"))
    dated = facts.balance_sheet_dates(f).select("doc_id", F.col("balance_sheet_date").cast("string").alias("dated"))
    return dated.join(held, "doc_id", "left").select("doc_id", "dated", "held_name", "held", facts.staff(F.lit(5.0), F.lit("1,200"), F.when(F.col("doc_id") % 2 == 0, -3).otherwise(0)).alias("staff"))


FACT_PARTS = """
WITH f AS (SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'R' THEN 'NetAssets' WHEN 'A' THEN 'Turnover' ELSE 'Debtors' END AS name, l_extendedprice AS value, CASE WHEN l_returnflag <> 'A' THEN CAST(l_shipdate AS DATE) END AS d, l_linestatus = 'O' AS seg FROM lineitem),
b AS (SELECT doc_id, max(d) AS d FROM f GROUP BY 1),
h AS (SELECT * FROM (SELECT f.doc_id, name, value, row_number() OVER (PARTITION BY f.doc_id ORDER BY CASE name WHEN 'NetAssets' THEN 1 ELSE 2 END, value DESC) AS k FROM f JOIN b ON f.doc_id = b.doc_id AND f.d = b.d WHERE NOT seg AND name <> 'Turnover') WHERE k = 1)
SELECT b.doc_id, CAST(b.d AS VARCHAR) AS dated, name AS held_name, abs(value) AS held, CASE WHEN b.doc_id % 2 = 0 THEN 1200.0 ELSE 5.0 END::DOUBLE AS staff FROM b LEFT JOIN h ON b.doc_id = h.doc_id
"""


def gates(spark, sf):
    """Figures of a gate over all rows and over those of one source, and of a full replacement."""
    c = load(spark, sf, "customer")
    old = c.where("c_custkey % 10 <> 0").select("c_custkey", (F.col("c_custkey") % 4 != 0).alias("is_active"), F.when(F.col("c_custkey") % 5 == 0, "api").otherwise("bulk").alias("record_source"))
    new = c.where("c_custkey % 7 <> 0").select("c_custkey").unionByName(c.where("c_custkey < 20").select("c_custkey"))
    pick = lambda df, side: df.select(F.lit(side).alias("side"), *(F.col(x).cast("long").alias(x) for x in ("old_total", "new_total", "currently_active", "would_be_inactivated", "dup_distinct", "dup_excess", "row_delta")), F.col("inactive_pct").cast("double").alias("inactive_pct"))
    return pick(snapshots.gate_figures(old, new, "c_custkey", only_active=False), "all").unionByName(pick(snapshots.gate_figures(old, new, "c_custkey", counted=F.col("record_source") == "bulk"), "bulk"))


GATES = """
WITH o AS (SELECT c_custkey AS k, c_custkey % 4 <> 0 AS up, c_custkey % 5 <> 0 AS bulk FROM customer WHERE c_custkey % 10 <> 0), n AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey < 20),
s AS (SELECT 'all' AS side, (SELECT count(*) FROM o) AS old_total, (SELECT count(*) FROM o WHERE up) AS live, (SELECT count(*) FROM o WHERE up AND k NOT IN (SELECT k FROM n)) AS gone
  UNION ALL SELECT 'bulk', (SELECT count(*) FROM o WHERE up AND bulk), (SELECT count(*) FROM o WHERE up AND bulk), (SELECT count(*) FROM o WHERE up AND bulk AND k NOT IN (SELECT k FROM n))),
d AS (SELECT count(*) AS a, coalesce(sum(c - 1), 0) AS b FROM (SELECT k, count(*) AS c FROM n GROUP BY 1 HAVING count(*) > 1))
SELECT side, old_total, (SELECT count(*) FROM n) AS new_total, live AS currently_active, gone AS would_be_inactivated, (SELECT a FROM d) AS dup_distinct, (SELECT b FROM d)::BIGINT AS dup_excess, (SELECT count(*) FROM n) - old_total AS row_delta, round(100.0 * gone / live, 2)::DOUBLE AS inactive_pct FROM s
"""


def ledger(spark, sf):
    """Batches whose counters never go down, stale ones failed, unseen and due targets, over orders."""
    o = load(spark, sf, "orders")
    batch = o.select("o_orderkey", (F.col("o_orderkey") % 10).alias("done"), F.when(F.col("o_orderkey") % 3 == 0, "running").otherwise("finished").alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    seen = o.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_orderkey") % 7).alias("done"))
    out = merges.fail_stale(merges.progress(batch, seen, "o_orderkey", ["done"]), "1999-01-01 00:00:00", 24)
    todo = merges.unseen(out, o.where("o_orderkey % 5 = 0").select("o_orderkey"), "o_orderkey")
    return todo.select("o_orderkey", F.col("done").cast("long").alias("done"), "status")


LEDGER = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN greatest(o_orderkey % 10, o_orderkey % 7) ELSE o_orderkey % 10 END::BIGINT AS done,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'finished' WHEN CAST(o_orderdate AS TIMESTAMP) < TIMESTAMP '1998-12-31 00:00:00' THEN 'failed' ELSE 'running' END AS status FROM orders WHERE o_orderkey % 5 <> 0
"""


def exclusions(spark, sf):
    """Companies off active lists, as NOT IN has it: without nulls, and with one."""
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("company_number"))
    out = c.where("company_number % 4 = 0")
    with_null = out.unionByName(spark.createDataFrame([(None,)], "company_number bigint"))
    some = scoring.not_excluded(c, out).withColumn("side", F.lit("plain"))
    none = scoring.not_excluded(c, with_null).withColumn("side", F.lit("null"))
    return some.unionByName(none).unionByName(scoring.not_excluded(c, out.limit(0)).withColumn("side", F.lit("empty")))


EXCLUSIONS = """
SELECT c_custkey AS company_number, 'plain' AS side FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)
UNION ALL SELECT c_custkey, 'null' FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT NULL)
UNION ALL SELECT c_custkey, 'empty' FROM customer
"""


def statement_texts(spark, sf):
    """Exemption statements, amounts and turnover rows in documents into which some are set; whole texts."""
    d = load(spark, sf, "documents")
    extra = ["", "the profit and loss account has not been delivered. Turnover: £ 1,234 ", "under the small companies regime Gross profit (2,500) ", "section 444 of the companies act 2006 fixed assets 77 ", "REVENUE - 9,000 average number of employees during the year: 45 "]
    t = F.concat(_picked("doc_id", extra), F.lit("| "), F.coalesce("text", F.lit("")))
    rows = d.select("doc_id", t.alias("t"), F.array(_picked("doc_id", ["Turnover 2 1,200 1,100", "Revenue £5,000 £4,000", "Group turnover 9,999 8,888%", "x"]), F.lit("Turnover 1,000 900,000")).alias("r"))
    return rows.select("doc_id", pages.exempt("t").alias("loose"), pages.exempt("t", True).alias("tight"), pages.amount("t", "revenue").alias("revenue"), pages.amount("t", "gross_profit").alias("gross"), pages.amount("t", "employee_count").alias("staff"), pages.row_turnover("r", 1000.0).alias("turnover"), pages.too_little_text("t", F.lit(3)).alias("scan"))


STATEMENT_TEXTS = """
WITH t AS (SELECT doc_id, doc_id % 5 AS k, doc_id % 4 AS j, length(trim(['', 'the profit and loss account has not been delivered. Turnover: £ 1,234 ', 'under the small companies regime Gross profit (2,500) ', 'section 444 of the companies act 2006 fixed assets 77 ', 'REVENUE - 9,000 average number of employees during the year: 45 '][1 + doc_id % 5] || '| ' || coalesce(text, ''), ' ')) AS n FROM documents)
SELECT doc_id, k IN (1, 2, 3) AS loose, k IN (1, 3) AS tight, CASE k WHEN 1 THEN 1234.0 WHEN 4 THEN 9000.0 END::DOUBLE AS revenue, CASE k WHEN 2 THEN -2500.0 END::DOUBLE AS gross, CASE k WHEN 4 THEN 45.0 END::DOUBLE AS staff,
  CASE j WHEN 0 THEN 1200000.0 WHEN 1 THEN 5000000.0 ELSE 1000000.0 END::DOUBLE AS turnover, n < 300 AS scan FROM t
"""

QUERIES = {
    "location_filters": (location_filters, LOCATION_FILTERS),
    "provider_filters": (provider_filters, PROVIDER_FILTERS),
    "listed_places": (listed_places, LISTED_PLACES),
    "in_scope": (in_scope, IN_SCOPE),
    "two_keys": (two_keys, TWO_KEYS),
    "register_projection": (register_projection, REGISTER_PROJECTION),
    "profile_update": (profile_update, PROFILE_UPDATE),
    "fetch_plan": (fetch_plan, FETCH_PLAN),
    "report_rows": (report_rows, REPORT_ROWS),
    "independence": (independence, INDEPENDENCE),
    "suspicion_rules": (suspicion_rules, SUSPICION_RULES),
    "director_backfill": (director_backfill, DIRECTOR_BACKFILL),
    "stored_flags": (stored_flags, STORED_FLAGS),
    "grouped_runs": (grouped_runs, GROUPED_RUNS),
    "page_parts": (page_parts, PAGE_PARTS),
    "numbered": (numbered, NUMBERED),
    "text_values": (text_values, TEXT_VALUES),
    "fact_parts": (fact_parts, FACT_PARTS),
    "gates": (gates, GATES),
    "ledger": (ledger, LEDGER),
    "exclusions": (exclusions, EXCLUSIONS),
    "statement_texts": (statement_texts, STATEMENT_TEXTS),
}
