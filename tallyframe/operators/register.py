"""The register table: from a bulk file's columns, from profile answers, and the rows of an upload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import col, joined_address, leading_code, parsed_date, stale
from ..functions.nested import directors_text
from ..functions.profiles import account_note, profile_columns

# The bulk file's columns, and the register's names for them.
AS_WRITTEN = {
    "company_number": "CompanyNumber",
    "company_name": "CompanyName",
    "company_status": "CompanyStatus",
    "company_type": "CompanyCategory",
    "country_of_origin": "CountryOfOrigin",
    "accounts_category": "Accounts.AccountCategory",
    "uri": "URI",
}
TRIMMED = {
    "address_care_of": "RegAddress.CareOf",
    "address_po_box": "RegAddress.POBox",
    "address_line_1": "RegAddress.AddressLine1",
    "address_line_2": "RegAddress.AddressLine2",
    "address_post_town": "RegAddress.PostTown",
    "address_county": "RegAddress.County",
    "address_country": "RegAddress.Country",
    "postcode": "RegAddress.PostCode",
}
DATES = {
    "incorporation_date": "IncorporationDate",
    "dissolution_date": "DissolutionDate",
    "accounts_next_due": "Accounts.NextDueDate",
    "accounts_last_made_up": "Accounts.LastMadeUpDate",
    "returns_next_due": "Returns.NextDueDate",
    "returns_last_made_up": "Returns.LastMadeUpDate",
    "conf_stmt_next_due": "ConfStmtNextDueDate",
    "conf_stmt_last_made_up": "ConfStmtLastMadeUpDate",
}
NUMBERS = {
    "accounts_ref_day": "Accounts.AccountRefDay",
    "accounts_ref_month": "Accounts.AccountRefMonth",
    "num_mort_charges": "Mortgages.NumMortCharges",
    "num_mort_outstanding": "Mortgages.NumMortOutstanding",
    "num_mort_part_satisfied": "Mortgages.NumMortPartSatisfied",
    "num_mort_satisfied": "Mortgages.NumMortSatisfied",
    "num_gen_partners": "LimitedPartnerships.NumGenPartners",
    "num_lim_partners": "LimitedPartnerships.NumLimPartners",
}
SIC_TEXTS, PREVIOUS_NAMES = 4, 10
NOT_FOUND, NOT_VALID = "Not found in the register", "Invalid company number"
SOURCE_LABELS = {"ixbrl": "Digital accounts", "pdf": "PDF", "ocr_pdf": "Scanned PDF (OCR)"}


def register_columns() -> dict[str, Column]:
    """The register's 60 columns over the bulk file's text columns; what can't be read as a date or number is null."""
    raw = lambda c: F.col(f"`{c}`")
    sic = {f"sic_{kind}_{k}": of(raw(f"SICCode.SicText_{k}")) for k in range(1, SIC_TEXTS + 1) for kind, of in (("code", leading_code), ("text", lambda c: c))}
    before = {f"prev_name_{k}{end}": raw(f"PreviousName_{k}.{part}") for k in range(1, PREVIOUS_NAMES + 1) for end, part in (("_date", "CONDATE"), ("", "CompanyName"))}
    return (
        {name: raw(c) for name, c in AS_WRITTEN.items()}
        | sic
        | {name: F.trim(raw(c)) for name, c in TRIMMED.items()}
        | {"registered_address": joined_address(*(raw(c) for name, c in TRIMMED.items() if name != "postcode"))}
        | {name: parsed_date(raw(c)) for name, c in DATES.items()}
        | {name: F.trim(raw(c)).try_cast("int") for name, c in NUMBERS.items()}
        | before
    )


def register_rows(bulk: DataFrame) -> DataFrame:
    return bulk.select(*(c.alias(name) for name, c in register_columns().items()))


def to_fetch(wanted: DataFrame, stored: DataFrame, as_of, refresh: bool = False, key: str = "company_number") -> DataFrame:
    """(key, state): 'new' without a stored row, 'again' if it is more than a month old, undated, or an answer's row under `refresh`; else 'present'."""
    have = stored.select(key, (stale("last_scrape_date", as_of, 1) | F.coalesce((F.col("record_source") == "api") & F.lit(refresh), F.lit(False))).alias("_again"))
    state = F.when(F.col("_again").isNull(), "new").when(F.col("_again"), "again").otherwise("present")
    return wanted.select(key).distinct().join(have, key, "left").select(key, state.alias("state"))


def apply_profiles(stored: DataFrame, answers: DataFrame, scrape_date, json: str = "raw_json", key: str = "company_number") -> DataFrame:
    """Stored rows with the columns that answers bring replaced, nulls too; other columns keep their values, and a bulk row stays one.

    Companies without a stored row come in with nulls in the columns that no answer has.  One answer a company is expected.
    """
    values = profile_columns(json) | {"last_scrape_date": F.lit(scrape_date).cast("date")}
    found = answers.select(*(v.alias(f"_n_{c}") for c, v in values.items()), F.lit(True).alias("_new"))
    joined = stored.join(found, F.col(key) == F.col(f"_n_{key}"), "full_outer")
    new, had = F.coalesce("_new", F.lit(False)), F.col(key).isNotNull()
    kinds = dict(stored.dtypes)

    def value(c: str) -> Column:
        if c not in values:
            return F.col(c)
        keep = ~new | (had & (F.coalesce(F.col("record_source"), F.lit("")) != "api")) if c == "record_source" else ~new
        return F.when(keep, F.col(c)).otherwise(F.col(f"_n_{c}").cast(kinds[c]))

    return joined.select(*(value(c).alias(c) for c in stored.columns))


# The columns of an upload's report.
REPORT = {
    "Company Number": "company_number",
    "Company Name": "company_name",
    "Incorporation Date": "incorporation_date",
    "Company Status": "company_status",
    "Total Active Directors": "total_active_directors",
    "Directors 60+": "directors_over_60",
    "Min Director Age": "min_director_age",
    "Avg Director Age": "avg_director_age",
    "Max Director Age": "max_director_age",
    "Employees": "employee_count",
    "Debtors": "debtors",
    "Current Assets": "current_assets",
    "Creditors Within One Year": "creditors_within_one_year",
    "Creditors After One Year": "creditors_after_one_year",
    "Provisions for Liabilities": "provisions_for_liabilities",
    "Deferred Tax": "deferred_tax",
    "Net Assets": "net_assets",
    "Total Assets": "total_assets",
    "Profit Before Tax": "profit_before_tax",
    "Accounts Period End": "filing_period_end",
}
_REPORT_ORDER = [*list(REPORT)[:4], "Directors", *list(REPORT)[4:18], "Revenue", *list(REPORT)[18:], "Accounts Source", "Notes"]


def report_rows(listed: DataFrame, companies: DataFrame, enrichment: DataFrame, as_of_year: int) -> DataFrame:
    """A report row of 24 columns for each listed row, in the list's order: (position, written, company_number), the number null where it isn't one.

    A revenue that an employee band gave isn't shown.  `enrichment` may lack columns, which are null then.
    """
    wanted = {*REPORT.values(), "directors", "directors_dob_years", "revenue", "revenue_source", "filing_id", "filing_format"} - {"company_number", "company_name", "incorporation_date", "company_status"}
    have = set(enrichment.columns)
    more = enrichment.select("company_number", *(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in sorted(wanted)))
    known = companies.select("company_number", "company_name", "incorporation_date", "company_status", F.lit(True).alias("_known"))
    rows = listed.join(known, "company_number", "left").join(more, "company_number", "left")
    revenue = F.when(F.coalesce(F.col("revenue_source"), F.lit("")) != "employee_band_lookup", F.col("revenue"))
    labels = F.create_map(*(F.lit(x) for pair in SOURCE_LABELS.items() for x in pair))
    found = F.coalesce("_known", F.lit(False))
    note = account_note("directors_dob_years", "total_active_directors", "avg_director_age", "revenue_source", "filing_id", revenue)
    people = F.nullif(directors_text("directors", as_of_year), F.lit("")) if "directors" in have else F.lit(None).cast("string")
    extra = {
        "Directors": people,
        "Revenue": revenue,
        "Accounts Source": labels[F.col("filing_format")],
        "Notes": F.when(F.col("company_number").isNull(), NOT_VALID).when(~found, NOT_FOUND).otherwise(note),
        "Company Number": F.coalesce("company_number", "written"),
    }
    value = lambda name: extra[name] if name in extra else F.col(REPORT[name])
    return rows.orderBy("position").select(*(value(name).alias(name) for name in _REPORT_ORDER))


def numbered_list(spark: SparkSession, written: list[str]) -> DataFrame:
    """(position, written, company_number) of an uploaded list: numbers in normal form, each once at its first place; what isn't one stays, with a null number."""
    from ..functions.codes import listed_number

    rows = spark.createDataFrame(list(enumerate(written)), "position int, written string").withColumn("company_number", listed_number("written"))
    rows = rows.where("trim(coalesce(written, '')) <> ''")
    once = rows.where("company_number is not null").groupBy("company_number").agg(F.min(F.struct("position", "written")).alias("_first")).select("_first.position", "_first.written", "company_number")
    return once.unionByName(rows.where("company_number is null"))
