import pytest
from pyspark.sql import functions as F

from tallyframe.functions import codes, nested, pages, scores, sites
from tallyframe.functions.similarity import common_subsequence, token_set_ratio


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} {t}" for k, t in zip(values, [type_of(v) for v in values.values()])) or "x int")
    return frame.select(column.alias("out")).first()[0]


def type_of(v):
    return {str: "string", int: "int", float: "double", bool: "boolean", type(None): "string"}[type(v)]


def column_of(spark, f, inputs):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string").select("k", f("v").alias("out")).orderBy("k").collect()
    return [r.out for r in rows]


def test_leading_codes(spark):
    assert column_of(spark, codes.leading_code, ["88100 - Social work activities", "  01110 - Growing of cereals", "None Supplied", "", "Code 123", None]) == ["88100", "01110", None, None, None, None]


def test_listed_numbers(spark):
    pairs = {"1": "00000001", " 1234 567 ": "01234567", "SC12345": "SC012345", "sc 012345": "SC012345", "R123": "R0000123", "oc300001": "OC300001", "1234567.0": "01234567"}
    assert column_of(spark, codes.listed_number, list(pairs)) == list(pairs.values())
    bad = ["1234567.5", "123456789", "SC1234567", "ABC12345", "1234567A", "12A45678", "12-345", "SC/12345", "ACME LTD", "SC", "", "  ", None]
    assert column_of(spark, codes.listed_number, bad) == [None] * len(bad)


def test_registry_numbers_keep_long_ones(spark):
    assert column_of(spark, codes.registry_number, ["12 3", "123456789", " sc1 ", "", None]) == ["00000123", "123456789", "SC1", None, None]
    assert column_of(spark, codes.loose_number, ["1234.0", "nan", "None", "AB1"]) == ["00001234", None, None, "AB1"]


def test_outward_codes_and_prefixes_differ(spark):
    assert column_of(spark, codes.outward_code, ["SW1A 1AA", "M11AE", "b1", "", None]) == ["SW1A", "M1", "B1", None, None]
    assert column_of(spark, codes.area_prefix, ["SW1A 1AA", "M11AE", "xyz"]) == ["SW1A", "M11", ""]


def test_names_and_dates(spark):
    assert column_of(spark, codes.name_key, ["The Bright-Support Ltd.", None]) == ["bright support", ""]
    assert column_of(spark, lambda c: codes.name_key(c, True), ["ABC Care Services Ltd"]) == ["abc"]
    assert [str(d) for d in column_of(spark, codes.parsed_date, ["01/02/2015", "2015-02-03", "x", None])] == ["2015-02-01", "2015-02-03", "None", "None"]
    assert column_of(spark, codes.account_number, ["1,234", "(5 000)", "abc"]) == [1234.0, -5000.0, None]
    assert column_of(spark, codes.headcount, ["-12.7", "1000000", "x"]) == [12, None, None]
    assert column_of(spark, codes.tri_state, ["y", "N", "maybe", None]) == [True, False, None, None]


def test_class_points(spark):
    expect = {
        "Majority domiciliary": 3, "Majority residential": 0, "Majority Supported living": 1, "Mixed_domiciliary_supported": 2, "Mixed_residential_domiciliary": 1, "likely domicilairy": 3,
        "Unable to classify": 0, "": 0, None: 0, "domiciliary": 3, "supported living": 1, "residential": 0, "primarily residential": 0, "predominantly domiciliary and residential": 3, "residential and supported": 0,
    }
    assert column_of(spark, scores.class_points, list(expect)) == list(expect.values())


def test_other_ladders(spark):
    assert one(spark, scores.size_points("r"), r=4999999.9999995) == 0
    assert [one(spark, scores.size_points("r"), r=float(x)) for x in (1e6, 5e6, 25e6, 25e6 + 1, 50e6 + 1)] == [1, 2, 2, 1, 0]
    assert one(spark, scores.tier(F.lit(6), F.lit(0))) == "Excluded"
    assert [one(spark, scores.tier(F.lit(t), F.lit(2))) for t in (6, 4, 3)] == ["Tier 1", "Tier 2", "Tier 3"]
    assert column_of(spark, scores.canonical_verdict, ["MAJORITY domiciliary care ", "odd", None]) == ["Majority domiciliary", "odd", "Unable to classify"]


def test_token_sets():
    assert token_set_ratio("bright support", "bright support") == 100
    assert token_set_ratio("bright support", "bright support homes") == 100
    assert token_set_ratio("abc cars", "abc care services") < 90
    assert token_set_ratio("", "x") == 0 == token_set_ratio(None, "x")
    assert common_subsequence("AGGTAB", "GXTXAYB") == 4


def test_sites(spark):
    assert column_of(spark, sites.domain_of, ["https://www.Web-Care.co.uk/x", "http://wwwide.com", "nothing"]) == ["web-care.co.uk", "wwwide.com", ""]
    assert column_of(spark, sites.is_root, ["https://a.uk", "https://a.uk/", "https://a.uk/x", "https://a.uk/?q=1"]) == [True, True, False, False]
    assert one(spark, sites.site_score("u", sites.name_tokens("n")), u="https://bright-support.co.uk/", n="Bright Support Ltd") == 13
    assert one(spark, sites.on_list("d", ["facebook.com"]), d="uk.facebook.com") is True


def test_ages(spark):
    officers = '[{"officer_role":"director","date_of_birth":{"year":1960}},{"officer_role":"Director","date_of_birth":{"year":1970}},{"officer_role":"director","resigned_on":"2020-01-01","date_of_birth":{"year":1950}},{"officer_role":"secretary","date_of_birth":{"year":1955}}]'
    for raw, want in ((officers, (61, 56, 66, 1, False)), ("[]", (None, None, None, 0, False))):
        years = nested.birth_years(nested.active_directors(F.from_json(F.lit(raw), nested.OFFICERS)))
        row = spark.range(1).select(*(v.alias(k) for k, v in nested.age_facts(years, 2026).items())).first()
        assert tuple(row) == want


def test_nested_people_and_ratings(spark):
    doc = '{"regulatedActivities":[{"name":"x"},{"nominatedIndividual":{"personTitle":"Ms","personGivenName":"Sarah","personFamilyName":"Robson"}}],"contacts":[{"personGivenName":"A","personRoles":["Other"]},{"personGivenName":"B","personRoles":["REGISTERED manager"]}],"ratings":[{"name":"Safe","rating":"Good"}]}'
    frame = spark.createDataFrame([(doc,)], "doc string")
    r = nested.ratings("doc", "$.ratings")
    row = frame.select(nested.nominated_individual("doc"), nested.contact_with_role("doc", "registered manager"), r["rating_safe"], r["rating_caring"]).first()
    assert tuple(row) == ("Ms Sarah Robson", "B", "Good", None)
    assert column_of(spark, nested.json_kind, ['{"a":1}', "[1]", '"x"', "1", "true", "null", "{bad"]) == ["OBJECT", "ARRAY", "VARCHAR", "NUMBER", "BOOLEAN", "NULL", None]


@pytest.mark.parametrize(
    "text,reason",
    [("", "empty"), ("Contents\nPage 1", "toc_or_cover"), ("Balance sheet 1,000 2,000", "primary_statement"), ("In our opinion the accounts give a fair view and we say so in many words", "audit_opinion"), ("Some plain words about nothing at all", "no_numeric_anchors"), ("1,000 2,000 3,000 4,000", "comma_dense")],
)
def test_page_rules(spark, text, reason):
    frame = spark.createDataFrame([(text,)], "t string").withColumns(pages.page_signals("t"))
    assert frame.select(pages.page_verdict()[1]).first()[0] == reason


def test_exemption_sets_differ(spark):
    assert column_of(spark, pages.exempt, ["under the small companies regime", "x"]) == [True, False]
    assert column_of(spark, lambda c: pages.exempt(c, True), ["under the small companies regime", "directors have elected not to deliver"]) == [False, True]
    assert one(spark, pages.row_turnover(F.array(F.lit("Turnover 2 1,000,000 900,000"), F.lit("Turnover 1,000 900"))), x=1) == 1000000.0
