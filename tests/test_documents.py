import datetime as dt

from pyspark.sql import functions as F

from tallyframe.functions import profiles
from tallyframe.operators import facts
from tallyframe.sources import documents


def test_html_rows():
    page = "<html><style>p{}</style><div><p>One <b>two</b></p><table><tr><td><p>Turnover</p></td><td>1,000</td><td>900</td></tr></table><div style='top:5px'>left</div><div style='top:5px'>right</div><div style='top:9px'>below</div><br>x</div>"
    assert documents.rows_of_html(page) == ["One two", "Turnover 1,000 900", "left right", "below"]
    assert documents.rows_of_html(None) == [] == documents.rows_of_html("</p>")


def test_html_frame(spark):
    rows = spark.createDataFrame([("<p>a</p><li>b",), (None,)], "html string")
    assert [r.rows for r in documents.text_rows(rows, "html").collect()] == [["a", "b"], []]


DOC = """<html xmlns:ix="http://www.xbrl.org/2013/inlineXBRL" xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi"><body>
<xbrli:context id="d"><xbrli:period><xbrli:startDate>2023-01-01</xbrli:startDate><xbrli:endDate>2023-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="i"><xbrli:entity><xbrli:segment><xbrldi:explicitMember dimension="c:Dim">c:WithinOneYear</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>2023-12-31</xbrli:instant></xbrli:period></xbrli:context>
<ix:nonFraction name="u:Turnover" contextRef="d" unitRef="GBP" scale="3">1,234</ix:nonFraction>
<ix:nonFraction name="u:Creditors" contextRef="i" unitRef="GBP" sign="-">50</ix:nonFraction></body></html>"""


def test_tagged_facts(spark):
    files = spark.createDataFrame([("a", DOC.encode()), ("b", b"<broken"), ("c", None)], "path string, content binary")
    rows = documents.tagged_facts(files).cache()
    got = {r.name: (r.doc_id, r.value, r.instant, r.enddate, r.members) for r in rows.collect()}
    assert got == {"Turnover": ("a", 1234000.0, None, dt.date(2023, 12, 31), []), "Creditors": ("a", -50.0, dt.date(2023, 12, 31), None, ["WithinOneYear"])}
    assert facts.at_balance_sheet(rows, ["Creditors"], ["WithinOneYear"], need_member=True).select(facts.liability("value")).first()[0] == 50.0
    assert documents.number_of("(1,5)") == -15.0 and documents.number_of("-") == 0.0 and documents.number_of("x") is None


def test_salvage():
    assert documents.salvaged_answer('noise {"a": 1} then {"verdict": "x", "evidence": "{"} tail') == '{"evidence": "{", "verdict": "x"}'
    assert documents.salvaged_answer("think {'verdict': 'y'}") == '{"verdict": "y"}'
    assert documents.salvaged_answer("{'verdict': 'y'} and more") is None and documents.salvaged_answer(None) is None and documents.salvaged_answer("{" * 50) is None


def test_profiles(spark):
    doc = '{"company_number":"1","company_status":"voluntary-arrangement","type":"private-unlimited-nsc","sic_codes":["88100","87300"],"registered_office_address":{"locality":"Leeds","postal_code":"LS1"},"accounts":{"accounting_reference_date":{"day":"31","month":"3"}},"date_of_creation":"2015-02-01"}'
    row = spark.createDataFrame([(doc,)], "d string").select(*(v.alias(k) for k, v in profiles.profile_columns("d").items())).first()
    assert (row.company_status, row.company_type, row.sic_code_2, row.sic_code_3, row.registered_address) == ("Voluntary Arrangement", "private-unlimited-nsc", "87300", None, "Leeds")
    assert (row.accounts_ref_day, row.incorporation_date, row.is_active, row.record_source) == (31, dt.date(2015, 2, 1), True, "api")


STATUSES = [
    ("active", None, "Active"),
    ("active", "active-proposal-to-strike-off", "Active - Proposal to Strike off"),
    ("receivership", None, "RECEIVERSHIP"),
    ("administration", None, "In Administration"),
    ("insolvency-proceedings", None, "Insolvency proceedings"),
    ("dissolved", "active-proposal-to-strike-off", "Dissolved"),
    (None, None, None),
]


def test_status_labels(spark):
    rows = spark.createDataFrame([(c, d) for c, d, _ in STATUSES], "c string, d string").select(profiles.status_label("c", "d")).collect()
    assert [r[0] for r in rows] == [want for *_, want in STATUSES]


#: directors known, active, average age, revenue source, filing id, revenue, employees; the note
NOTES = [
    (None, 0, None, "no_recent_filing", None, None, None, "Directors not fetched; No accounts filed"),
    ("[]", 0, None, "pdf_no_text_layer", "f", None, None, "No active directors; Scanned PDF accounts - figures pending OCR"),
    ("[1]", 1, None, None, None, None, None, "No director dates of birth; Accounts not fetched"),
    ("[1]", 1, 50, None, "f", None, None, "Accounts found but could not be read"),
    ("[1]", 1, 50, None, "f", None, 9, "Revenue not in filed accounts"),
    ("[1]", 1, 50, "filed_accounts_pdf", "f", 5.0, 9, None),
]


def test_account_notes(spark):
    rows = spark.createDataFrame([n[:-1] for n in NOTES], "k string, n int, a int, s string, f string, revenue double, employee_count int")
    out = rows.select(profiles.account_note("k", "n", "a", "s", "f", "revenue", ("employee_count", "revenue"))).collect()
    assert [r[0] for r in out] == [n[-1] for n in NOTES]


#: name, owner, charity, brand, type; decision and reason
INDEPENDENT = [
    ("A Ltd", "Organisation", None, None, "Private Limited Company", "include", "company_type=Private Limited Company"),
    ("A Ltd", "Individual", "1", "b", None, "exclude", "ownership_type=Individual"),
    ("A Ltd", "Organisation", "77", "b", None, "exclude", "has charity_number=77"),
    ("Some Borough Council Trust", None, "", "b", None, "exclude", "name contains 'trust'"),
    ("A Ltd", None, None, "Chain", "x", "exclude", "franchise/chain brand=Chain"),
    ("A Ltd", None, None, None, "PRI/LBG/NSC (Private)", "exclude", "company_type starts with PRI/LBG/NSC"),
    ("A Ltd", None, None, None, "Limited Partnership", "review", "company_type=Limited Partnership (rare commercial form)"),
    ("A Ltd", None, None, None, "", "review", "no company_type available"),
    ("A Ltd", None, None, None, "Odd", "review", "unknown company_type=Odd"),
]


def test_independence_and_gaps(spark):
    rows = spark.createDataFrame([r[:5] for r in INDEPENDENT], "n string, o string, c string, b string, t string")
    out = rows.select(*profiles.independence("n", "o", "c", "b", "t")).collect()
    assert [tuple(r) for r in out] == [r[5:] for r in INDEPENDENT]
    gaps = spark.createDataFrame([("Domiciliary Care + Supported Living", 70.0, 1), ("Domiciliary Care", 60.0, None), ("Domiciliary Care", None, 1), ("Domiciliary Care", 59.5, 0), ("x", 70.0, 1)], "c string, a double, n int")
    assert [r[0] for r in gaps.select(profiles.gap_tier("c", "a", "n")[0]).collect()] == ["Tier 3", "Tier 1", "Tier 1", "Tier 2", "Excluded"]
