"""Codes, names, JSON, sites, pages, matching, bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, nested, pages, scores, sites
from ..operators import bundles, facts, grouping, matching
from ..session import ship
from .tables import load


def normalise_number(spark, sf):
    c = load(spark, sf, "customer")
    raw = F.concat(F.element_at(F.array(*map(F.lit, ["", " sc ", "R", "12 "])), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", codes.registry_number(raw).alias("registry"), codes.listed_number(raw).alias("listed"), codes.leading_code(raw).alias("code"))


NORMALISE_NUMBER = r"""
WITH r AS (SELECT c_custkey, ['', ' sc ', 'R', '12 '][1 + c_custkey % 4] || c_custkey AS raw FROM customer), t AS (SELECT *, regexp_replace(upper(raw), '\s+', '', 'g') AS t FROM r)
SELECT c_custkey, CASE WHEN regexp_full_match(t, '[0-9]+') AND length(t) < 8 THEN lpad(t, 8, '0') ELSE t END AS registry,
  CASE WHEN regexp_full_match(t, '[0-9]{1,8}') THEN lpad(t, 8, '0') WHEN regexp_full_match(t, '[A-Z]{1,2}[0-9]+') AND length(t) <= 8 THEN regexp_extract(t, '^[A-Z]+') || repeat('0', 8 - length(t)) || regexp_extract(t, '[0-9]+$') END AS listed,
  nullif(regexp_extract(raw, '^\s*([0-9]+)', 1), '') AS code FROM t
"""


def normalise_name(spark, sf):
    p = load(spark, sf, "part")
    name = F.concat(F.lit("The "), F.col("p_name"), F.lit(" & Care-Services (UK) Ltd."))
    return p.select("p_partkey", codes.name_key(name).alias("mild"), codes.name_key(name, True).alias("bold"))


NORMALISE_NAME = r"""
WITH n AS (SELECT p_partkey, string_split_regex(trim(regexp_replace(lower('The ' || p_name || ' & Care-Services (UK) Ltd.'), '[^a-z0-9 ]+', ' ', 'g')), '\s+') AS w FROM part)
SELECT p_partkey, array_to_string([x for x in w if x NOT IN ('ltd', 'limited', 'plc', 'llp', 'the', 'uk', '')], ' ') AS mild, array_to_string([x for x in w if x NOT IN ('ltd', 'limited', 'plc', 'llp', 'the', 'uk', 'care', 'services', '')], ' ') AS bold FROM n
"""


def outward_code(spark, sf):
    c = load(spark, sf, "customer")
    post = F.element_at(F.array(*map(F.lit, ["sw1a 1aa", "M11AE", "b1", " ", "EC1A  1BB", "x"])), (F.col("c_custkey") % 6 + 1).cast("int"))
    return c.select("c_custkey", codes.outward_code(post).alias("outward"), codes.area_prefix(post).alias("area"))


OUTWARD = r"""
WITH p AS (SELECT c_custkey, ['sw1a 1aa', 'M11AE', 'b1', ' ', 'EC1A  1BB', 'x'][1 + c_custkey % 6] AS post FROM customer), t AS (SELECT *, regexp_replace(upper(post), '\s+', '', 'g') AS t FROM p)
SELECT c_custkey, CASE WHEN t = '' THEN NULL WHEN length(t) <= 4 THEN t ELSE substr(t, 1, length(t) - 3) END AS outward, regexp_extract(upper(trim(post)), '^([A-Z]{1,2}[0-9][A-Z0-9]?)', 1) AS area FROM t
"""


def clean_values(spark, sf):
    """Flags, tri-state, whole and account numbers, dates."""
    o = load(spark, sf, "orders")
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (F.col("o_orderkey") % len(items) + 1).cast("int"))
    flag, amount, day = pick(["Y", "no", "", "TRUE", "x"]), pick(["1,234", "(5,000)", "abc", "12.7", " 8 "]), pick(["01/02/2015", "2015-02-03", "", "31/12/1999"])
    return o.select(
        "o_orderkey", codes.flag(flag).alias("flag"), codes.tri_state(flag).alias("state"), codes.whole_number(amount).alias("whole"), codes.account_number(amount).alias("amount"), codes.parsed_date(day).alias("day"),
        codes.clean_text(pick(["a ", "-", "*", "", "b"])).alias("text"), codes.joined_address(pick(["1 High St", " ", ""]), F.lit(None).cast("string"), pick(["Town", ""])).alias("address"),
    )


CLEAN_VALUES = """
SELECT o_orderkey, o_orderkey % 5 IN (0, 3) AS flag, CASE o_orderkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 3 THEN TRUE END AS state,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN 1234 WHEN 3 THEN 12 WHEN 4 THEN 8 END AS INTEGER) AS whole, CAST(CASE o_orderkey % 5 WHEN 0 THEN 1234 WHEN 1 THEN -5000 WHEN 3 THEN 12.7 WHEN 4 THEN 8 END AS DOUBLE) AS amount,
  CASE o_orderkey % 4 WHEN 0 THEN DATE '2015-02-01' WHEN 1 THEN DATE '2015-02-03' WHEN 3 THEN DATE '1999-12-31' END AS day, CASE o_orderkey % 5 WHEN 0 THEN 'a' WHEN 4 THEN 'b' END AS text,
  concat_ws(', ', CASE o_orderkey % 3 WHEN 0 THEN '1 High St' END, CASE o_orderkey % 2 WHEN 0 THEN 'Town' END) AS address FROM orders
"""


def date_spans(spark, sf):
    o = load(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    as_of = F.lit("2000-03-31").cast("date")
    return o.select("o_orderkey", codes.whole_months("d", as_of).cast("long").alias("months"), codes.stale("d", as_of).alias("stale"), codes.stale_days("d", as_of).alias("stale_days"), codes.age_in_year(F.year("d"), as_of).cast("long").alias("age"), F.round(codes.years_between("d", as_of), 6).alias("years"))


DATE_SPANS = """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '2000-03-31' AS a FROM orders)
SELECT o_orderkey, greatest((year(a) - year(d)) * 12 + month(a) - month(d) - CASE WHEN day(a) < day(d) THEN 1 ELSE 0 END, 0) AS months, d < DATE '2000-02-29' AS stale, d < DATE '2000-03-01' AS stale_days, year(a) - year(d) AS age, round(datediff('day', d, a) / 365.25, 6) AS years FROM o
"""


def verdict_labels(spark, sf):
    o = load(spark, sf, "orders")
    raw = F.element_at(F.array(*map(F.lit, [" MAJORITY Domiciliary care", "mixed residential domiciliary", "", "Something else", "Majority supported living"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", scores.canonical_verdict(raw).alias("verdict"), codes.labelled(F.col("o_orderstatus"), {"F": "Finished", "O": "Open"}).alias("label"))


VERDICT_LABELS = "SELECT o_orderkey, ['Majority domiciliary', 'Mixed_residential_domiciliary', 'Unable to classify', 'Something else', 'Majority Supported living'][1 + o_orderkey % 5] AS verdict, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS label FROM orders"


def json_extract(spark, sf):
    """Fields, parts and lengths of lists that two events of three have, and the kind of each value."""
    e = load(spark, sf, "events")
    n = F.col("event_id") % 3
    doc = F.concat(F.lit('{"p":'), F.col("props"), F.when(n == 1, ',"l":[1,{"a":2}]}').when(n == 2, ',"l":[]}').otherwise("}"))
    values = F.element_at(F.array(*map(F.lit, ["[1]", '{"a": 1}', '"x"', "-1.5", "true", "null"])), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", nested.field(doc, "$.p.k").cast("long").alias("k"), nested.part(doc, "$.l").alias("part"), nested.list_length(doc, "$.l").cast("long").alias("items"), nested.json_kind("props").alias("kind"), nested.json_kind(values).alias("other"))


JSON_EXTRACT = """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_id % 3 WHEN 1 THEN '[1,{"a":2}]' ELSE '[]' END AS part, CASE event_id % 3 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS items, json_type(props) AS kind,
  ['ARRAY', 'OBJECT', 'VARCHAR', 'NUMBER', 'BOOLEAN', 'NULL'][1 + event_id % 6] AS other FROM events
"""


def json_array_pick(spark, sf):
    """First contact with a role, and key-question ratings, from documents built of line items."""
    o = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity"))).alias("items"))
    contacts = F.transform("items", lambda x: F.struct(F.lit("Dr").alias("personTitle"), x["l_returnflag"].alias("personGivenName"), x["l_linenumber"].cast("string").alias("personFamilyName"), F.array(F.when(x["l_quantity"] > 25, "Main Partner").otherwise("Other")).alias("personRoles")))
    rated = F.transform("items", lambda x: F.struct(F.when(x["l_linenumber"] == 1, "Safe").otherwise("Well-led").alias("name"), x["l_returnflag"].alias("rating")))
    doc = F.to_json(F.struct(contacts.alias("contacts"), rated.alias("ratings")))
    r = nested.ratings("doc", "$.ratings")
    return o.withColumn("doc", doc).select("l_orderkey", nested.contact_with_role("doc", "main partner").alias("partner"), r["rating_safe"].alias("safe"), r["rating_well_led"].alias("well_led"))


JSON_ARRAY_PICK = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity) AS k FROM lineitem)
SELECT l_orderkey, arg_min('Dr ' || l_returnflag || ' ' || l_linenumber, k) FILTER (WHERE l_quantity > 25) AS partner, arg_min(l_returnflag, k) FILTER (WHERE l_linenumber = 1) AS safe,
  arg_min(l_returnflag, k) FILTER (WHERE l_linenumber <> 1) AS well_led FROM r GROUP BY 1
"""


def director_ages(spark, sf):
    """Orders of a customer as officers born in the sixties: ages of the active directors."""
    o = load(spark, sf, "orders")
    officer = F.struct(
        F.col("o_orderkey").cast("string").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, "secretary").otherwise("Managing-Director").alias("officer_role"), F.lit(None).cast("string").alias("appointed_on"),
        F.when(F.col("o_orderkey") % 5 == 0, "2020-01-01").alias("resigned_on"), F.struct((F.col("o_orderkey") % 25 + 1950).cast("int").alias("year"), F.lit(1).alias("month")).alias("date_of_birth"),
    )
    rows = o.groupBy("o_custkey").agg(F.collect_list(officer).alias("officers")).withColumn("directors", nested.active_directors("officers")).withColumn("years", nested.birth_years("directors"))
    ages = nested.age_facts("years", 2026)
    return rows.select("o_custkey", *(v.cast("boolean" if k.startswith("all") else "long").alias(k) for k, v in ages.items()))


DIRECTOR_AGES = """
WITH d AS (SELECT o_custkey, 2026 - (1950 + o_orderkey % 25) AS age FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0),
g AS (SELECT o_custkey, CAST(floor(avg(age)) AS BIGINT) AS a, min(age) AS lo, max(age) AS hi, count(*) FILTER (WHERE age >= 60) AS n60, bool_and(age >= 60) AS b FROM d GROUP BY 1)
SELECT o_custkey, a AS avg_director_age, lo AS min_director_age, hi AS max_director_age, coalesce(n60, 0) AS directors_over_60, coalesce(b, FALSE) AS all_directors_60_plus FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN g USING (o_custkey)
"""


def host_score(spark, sf):
    """Page addresses scored for a name, best reachable one a language."""
    p = load(spark, sf, "pages").select("page_id", "url", F.array(F.lit("example"), F.lit("thth")).alias("tokens"))
    return p.select("page_id", sites.domain_of("url").alias("domain"), sites.is_root("url").alias("is_root"), sites.root_url("url").alias("root"), sites.site_score("url", "tokens").cast("long").alias("score"), sites.on_list(sites.domain_of("url"), ["example.net"]).alias("denied"), sites.pick_reason("url", "tokens").alias("reason"))


HOST_SCORE = r"""
WITH d AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS domain, regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?(#.*)?') AS is_root, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || '/' AS root FROM pages),
t AS (SELECT *, CASE WHEN domain LIKE '%.uk' THEN 3 WHEN domain LIKE '%.com' THEN 1 ELSE 0 END AS place, contains(replace(domain, '-', ''), 'example') AS a, contains(replace(domain, '-', ''), 'thth') AS b FROM d)
SELECT page_id, domain, is_root, root, CAST(place + 2 * is_root::INT + 4 * (a::INT + b::INT) AS BIGINT) AS score, domain = 'example.net' OR domain LIKE '%.example.net' AS denied,
  CASE WHEN domain LIKE '%.uk' THEN 'top_scored_with_uk_tld' WHEN a OR b THEN 'top_scored_name_overlap' WHEN is_root THEN 'top_scored_root_url' WHEN domain LIKE '%.com' THEN 'top_scored_with_com_tld' ELSE 'top_scored_above_threshold' END AS reason FROM t
"""


def site_pick(spark, sf):
    """Best candidate address of each first letter: not denied, reachable ones first, a score of 4 or more."""
    p = load(spark, sf, "pages").select("page_id", "url", F.array(F.lit("example")).alias("tokens")).withColumn("domain", sites.domain_of("url"))
    rows = p.withColumns({"score": sites.site_score("url", "tokens"), "grp": F.substring("domain", 1, 3), "up": F.col("page_id") % 2})
    best = grouping.first_by(rows.where(~sites.on_list("domain", ["example.net"])), "grp", F.desc("up"), F.desc("score"), F.col("page_id"))
    return best.where(F.col("score") >= sites.MIN_SCORE).select("grp", "page_id", F.col("score").cast("long").alias("score"))


SITE_PICK = r"""
WITH d AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS domain FROM pages),
s AS (SELECT page_id, substr(domain, 1, 3) AS grp, CASE WHEN domain LIKE '%.uk' THEN 3 WHEN domain LIKE '%.com' THEN 1 ELSE 0 END + 2 * regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?(#.*)?')::INT + 4 * contains(replace(domain, '-', ''), 'example')::INT AS score FROM d WHERE NOT (domain = 'example.net' OR domain LIKE '%.example.net'))
SELECT grp, page_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY page_id % 2 DESC, score DESC, page_id) AS k FROM s) WHERE k = 1 AND score >= 4
"""


SET_IN = ["", "Balance sheet 2020 2019 Turnover 1,234 2,345 ", "Notes to the accounts: average number of employees 12 ", "In our opinion the basis for opinion ", "£'000 debtors 123456789012345678901234567890123 ", "Strategic report on the public benefit ", "Notes to the financial statements 1,000 2,000 3,000 4,000 ", "the accounting policies, section 444 "]


def page_filter(spark, sf):
    """Keep rules over every whole document, into most of which accounts are set."""
    d = load(spark, sf, "documents")
    extra = F.element_at(F.array(*map(F.lit, SET_IN)), (F.col("doc_id") % len(SET_IN) + 1).cast("int"))
    rows = d.select("doc_id", F.concat(extra, F.coalesce("text", F.lit(""))).alias("t")).withColumns(pages.page_signals("t"))
    score, reason = pages.page_verdict()
    return rows.select("doc_id", score.cast("long").alias("score"), reason.alias("reason"), pages.page_kept(score).alias("kept"), pages.exempt("t").alias("exempt"), pages.amount("t", "revenue").alias("revenue"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _says(pattern: str) -> str:
    return f"regexp_matches(t, {_quoted(pattern)})"


def _times(pattern: str) -> str:
    return f"len(regexp_extract_all(t, {_quoted(pattern)}))"


PAGE_FILTER = f"""
WITH t AS (SELECT doc_id, [{', '.join(map(_quoted, SET_IN))}][1 + doc_id % {len(SET_IN)}] || coalesce(text, '') AS t FROM documents),
a AS (SELECT *, length(t) AS n, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digits, {_times(pages.COMMA_NUMBER)} AS commas, {_times(pages.LINE_ITEMS)} AS items, {_says(pages.STATEMENTS)} AS st, {_says(pages.NOTES)} AS notes, {_says(pages.STAFF_NUMBER)} AS staff,
  {_says(pages.YEAR_PAIR)} AS years, {_says(pages.POUND_THOUSANDS)} AS thousands, {_says(pages.AUDIT)} AS audit, {_says(pages.REPORT)} AS report, {_says(pages.POLICY)} AS policy, {_says(pages.CONTENTS)} AS contents, {_says(pages.COVER)} AS cover FROM t),
s AS (SELECT *, digits / greatest(n, 1) AS den, least(commas, 8) * 5 + least(items, 6) * 4 + CAST(trunc(digits / greatest(n, 1) * 100) AS INT) + 30 * st::INT + 20 * notes::INT + 10 * years::INT + 10 * thousands::INT - 30 * audit::INT - 25 * report::INT - 15 * policy::INT AS total FROM a),
r AS (SELECT *, CASE WHEN NOT regexp_matches(t, '\\S') THEN 'empty' WHEN (contents AND n < 600) OR (cover AND n < 500 AND commas = 0) THEN 'toc_or_cover' WHEN audit AND commas <= 1 AND den < 0.04 AND NOT st THEN 'audit_opinion'
  WHEN report AND commas = 0 AND den < 0.03 AND NOT st AND items < 2 THEN 'strategic_prose' WHEN policy AND commas = 0 AND items < 2 AND NOT st AND den < 0.025 THEN 'policy_only_prose' WHEN st AND commas >= 2 THEN 'primary_statement' WHEN st AND items >= 2 AND den > 0.04 THEN 'primary_statement_numeric'
  WHEN notes AND commas >= 4 THEN 'notes_numeric' WHEN notes AND items >= 2 AND commas >= 2 THEN 'notes_lineitems' WHEN notes AND staff THEN 'notes_employee_count' WHEN commas >= 4 THEN 'comma_dense' WHEN years AND items >= 1 AND digits >= 40 THEN 'year_pair_table'
  WHEN thousands AND items >= 1 AND digits >= 30 THEN 'pound_thous_table' WHEN commas >= 2 AND items >= 2 THEN 'prose_with_numbers' WHEN commas = 0 AND NOT years AND NOT thousands THEN 'no_numeric_anchors' ELSE 'score_fallback' END AS reason FROM s),
k AS (SELECT *, CASE reason WHEN 'empty' THEN 0 WHEN 'toc_or_cover' THEN -100 WHEN 'audit_opinion' THEN -90 WHEN 'strategic_prose' THEN -80 WHEN 'policy_only_prose' THEN -70 WHEN 'primary_statement' THEN 100 WHEN 'primary_statement_numeric' THEN 95 WHEN 'notes_numeric' THEN 90 WHEN 'notes_lineitems' THEN 80
  WHEN 'notes_employee_count' THEN 75 WHEN 'comma_dense' THEN 70 WHEN 'year_pair_table' THEN 60 WHEN 'pound_thous_table' THEN 55 WHEN 'prose_with_numbers' THEN 50 WHEN 'no_numeric_anchors' THEN -50 ELSE total END AS score FROM r)
SELECT doc_id, CAST(score AS BIGINT) AS score, reason, score >= 30 AS kept, {' OR '.join(map(_says, pages.EXEMPT_LOOSE))} AS exempt,
  TRY_CAST(regexp_replace(trim(coalesce({', '.join(f"CASE WHEN {_says(p)} THEN regexp_extract(t, {_quoted(p)}, 1) END" for p in pages.AMOUNTS["revenue"])})), '[,\\s]', '', 'g') AS DOUBLE) AS revenue FROM k
"""


def site_bundle(spark, sf):
    """Conversations as sites, turns as pages."""
    c = load(spark, sf, "conversations").withColumns({"path": F.col("turn").cast("string"), "status": F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, 404).otherwise(200)})
    return bundles.site_bundles(c, "conv_id", "turn", "path", "text", "status")


SITE_BUNDLE = """
WITH u AS (SELECT * FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, substr(text, 1, 100) ORDER BY turn) AS k FROM conversations WHERE (conv_id + turn) % 5 <> 0 AND length(text) >= 80) WHERE k = 1),
b AS (SELECT conv_id, string_agg('## Page: /' || turn || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY turn) AS a, count(*) AS n FROM u GROUP BY 1),
s AS (SELECT conv_id, bool_or((conv_id + turn) % 5 <> 0) AS any_up FROM conversations GROUP BY 1)
SELECT conv_id, substr(coalesce(a, ''), 1, 12000) AS content, coalesce(length(a) > 12000, FALSE) AS truncated, coalesce(n, 0) AS pages_used,
  CASE WHEN length(substr(coalesce(a, ''), 1, 12000)) < 200 THEN CASE WHEN any_up THEN 'no_content' ELSE 'all_pages_unreachable' END END AS failure FROM s LEFT JOIN b USING (conv_id)
"""


def direct_match(spark, sf):
    """Customers and suppliers that share a number by two sources; two numbers a supplier are a conflict."""
    companies = load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("n")).select(codes.registry_number("n").alias("company_number"))
    s = load(spark, sf, "supplier")
    numbers = s.select(F.col("s_suppkey").alias("provider_id"), F.lit("hsca").alias("source"), F.col("s_suppkey").cast("string").alias("number")).unionByName(s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("provider_id"), F.lit("api").alias("source"), (F.col("s_suppkey") + F.col("s_suppkey") % 4 / 2).cast("long").cast("string").alias("number")))
    return matching.direct_matches(companies, numbers).select("company_number", "provider_id", F.col("total_score").cast("long").alias("total_score"), "status")


DIRECT_MATCH = """
WITH n AS (SELECT s_suppkey AS p, s_suppkey AS x FROM supplier UNION SELECT s_suppkey, s_suppkey + (s_suppkey % 4) // 2 FROM supplier WHERE s_suppkey % 2 = 0), k AS (SELECT p, count(DISTINCT x) AS c FROM n GROUP BY 1)
SELECT lpad(CAST(x AS VARCHAR), 8, '0') AS company_number, p AS provider_id, CAST(CASE WHEN c > 1 THEN 89 ELSE 100 END AS BIGINT) AS total_score, CASE WHEN c > 1 THEN 'needs_review' ELSE 'auto_confirmed' END AS status FROM n JOIN k USING (p) WHERE x IN (SELECT c_custkey FROM customer)
"""


def fuzzy_match(spark, sf):
    """Parts as companies and as providers with a word added, inside a block of the part's size."""
    ship(spark)
    p = load(spark, sf, "part")
    block = F.concat(F.lit("A"), F.col("p_size").cast("string"))
    companies = p.select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("company_number"), F.concat("p_name", F.lit(" "), F.col("p_brand"), F.lit(" Limited")).alias("company_name"), F.concat(block, F.lit("1AA")).alias("postcode"))
    providers = p.select(F.col("p_partkey").alias("provider_id"), F.concat(F.lit("The "), F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" Ltd")).alias("provider_name"), F.array(block).alias("postcode_prefixes_list"))
    return matching.fuzzy_matches(companies, providers, spark.createDataFrame([], "company_number string, provider_id bigint")).select("company_number", "provider_id", F.col("total_score").cast("long").alias("total_score"), "status")


def fact_pick(spark, sf):
    """Line items as facts of an order: the fact of each document by name, segment, date and value."""
    li = load(spark, sf, "lineitem")
    f = li.select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", "Turnover").otherwise("Revenue").alias("name"), F.col("l_extendedprice").alias("value"), F.col("l_shipdate").cast("date").alias("instant"),
        F.lit(None).cast("date").alias("startdate"), F.lit(None).cast("date").alias("enddate"), F.when(F.col("l_linestatus") == "O", F.array(F.lit("Group"))).otherwise(F.array().cast("array<string>")).alias("members"),
    )
    return facts.pick(f, ["Turnover", "Revenue"], instant=True).select("doc_id", "name", "value")


FACT_PICK = """
SELECT doc_id, name, value FROM (SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'R' THEN 'Turnover' ELSE 'Revenue' END AS name, l_extendedprice AS value,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_linestatus = 'O', CAST(l_shipdate AS DATE) DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1
"""

QUERIES = {
    "normalise_number": (normalise_number, NORMALISE_NUMBER),
    "normalise_name": (normalise_name, NORMALISE_NAME),
    "outward_code": (outward_code, OUTWARD),
    "clean_values": (clean_values, CLEAN_VALUES),
    "date_spans": (date_spans, DATE_SPANS),
    "verdict_labels": (verdict_labels, VERDICT_LABELS),
    "json_extract": (json_extract, JSON_EXTRACT),
    "json_array_pick": (json_array_pick, JSON_ARRAY_PICK),
    "director_ages": (director_ages, DIRECTOR_AGES),
    "host_score": (host_score, HOST_SCORE),
    "site_pick": (site_pick, SITE_PICK),
    "page_filter": (page_filter, PAGE_FILTER),
    "site_bundle": (site_bundle, SITE_BUNDLE),
    "direct_match": (direct_match, DIRECT_MATCH),
    "fuzzy_match": (fuzzy_match, None),
    "fact_pick": (fact_pick, FACT_PICK),
}
