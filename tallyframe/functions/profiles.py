"""Company profiles from stored answers, and the labels and decision ladders of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import blank_to_null, col, joined_address
from .scores import ladder

PROFILE = (
    "company_number string, company_name string, company_status string, company_status_detail string, type string, date_of_creation string, date_of_cessation string, sic_codes array<string>, "
    "registered_office_address struct<care_of: string, po_box: string, address_line_1: string, address_line_2: string, locality: string, region: string, country: string, postal_code: string>, "
    "accounts struct<next_due: string, last_accounts: struct<made_up_to: string, type: string>, accounting_reference_date: struct<day: string, month: string>>, "
    "confirmation_statement struct<next_due: string, last_made_up_to: string>"
)
# Status and type codes with labels of their own, statuses that aren't active, and where figures were read.
STATUS_LABELS = {
    "active": "Active",
    "dissolved": "Dissolved",
    "liquidation": "Liquidation",
    "administration": "In Administration",
    "voluntary-arrangement": "Voluntary Arrangement",
    "receivership": "RECEIVERSHIP",
}
TYPE_LABELS = {
    "ltd": "Private Limited Company",
    "plc": "Public Limited Company",
    "llp": "Limited Liability Partnership",
    "limited-partnership": "Limited Partnership",
    "private-limited-guarant-nsc": "PRI/LTD BY GUAR/NSC (Private, limited by guarantee, no share capital)",
    "private-limited-guarant-nsc-limited-exemption": "PRI/LBG/NSC (Private, Limited by guarantee, no share capital, use of 'Limited' exemption)",
    "private-unlimited": "Private Unlimited Company",
    "charitable-incorporated-organisation": "Charitable Incorporated Organisation",
    "scottish-charitable-incorporated-organisation": "Scottish Charitable Incorporated Organisation",
    "registered-overseas-entity": "Overseas Entity",
    "royal-charter": "Royal Charter Company",
    "scottish-partnership": "Scottish Partnership",
    "old-public-company": "Old Public Company",
}
INACTIVE_STATUSES = ("dissolved", "converted-closed", "removed", "closed")
STRIKE_OFF_DETAIL, STRIKE_OFF_LABEL = "active-proposal-to-strike-off", "Active - Proposal to Strike off"
FILING_FIGURES = ("employee_count", "debtors", "current_assets", "creditors_within_one_year", "creditors_after_one_year", "provisions_for_liabilities", "deferred_tax", "total_assets", "net_assets", "revenue", "profit_before_tax", "filing_period_end")
# Signs that a provider isn't independent.
DEPENDENT_OWNERS = ("Individual", "Partnership", "NHS Body")
DEPENDENT_WORDS = ("charity", "trust", "council", "borough council", "county council", "nhs", "foundation", "association", "society")
INCLUDED_TYPES = ("Private Limited Company", "Limited Liability Partnership")
EXCLUDED_TYPES = ("Registered Society", "Community Interest Company", "Charitable Incorporated Organisation", "Scottish Charitable Incorporated Organisation", "Royal Charter Company", "Industrial and Provident Society", "Other company type", "Other Company Type", "Overseas Entity")
EXCLUDED_TYPE_STARTS = ("PRI/LTD BY GUAR/NSC", "PRI/LBG/NSC")
RARE_TYPES = ("Private Unlimited Company", "Limited Partnership", "Public Limited Company")


def status_label(status, detail) -> Column:
    """Label of a status code; one detail has its own; an unknown code has hyphens as spaces, and only its first letter is upper case."""
    code = col(status)
    known = F.create_map(*(F.lit(x) for pair in STATUS_LABELS.items() for x in pair))
    plain = F.lower(F.regexp_replace(code, "-", " "))
    other = F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 2**30))
    return F.when((code == "active") & (col(detail) == STRIKE_OFF_DETAIL), STRIKE_OFF_LABEL).otherwise(F.coalesce(known[code], other))


def type_label(code) -> Column:
    """Label of a type code; an unknown code stays as it is."""
    known = F.create_map(*(F.lit(x) for pair in TYPE_LABELS.items() for x in pair))
    return F.coalesce(known[col(code)], col(code))


def profile_columns(json) -> dict[str, Column]:
    """Register columns of one profile answer; an address without parts is null."""
    p = F.from_json(col(json), PROFILE)
    a, accounts, statement = p["registered_office_address"], p["accounts"], p["confirmation_statement"]
    status = blank_to_null(p["company_status"])
    day = lambda c: c.try_cast("date")
    return {
        "company_number": p["company_number"],
        "company_name": p["company_name"],
        "company_status": status_label(status, blank_to_null(p["company_status_detail"])),
        "company_type": type_label(blank_to_null(p["type"])),
        **{f"sic_code_{k + 1}": F.get(p["sic_codes"], F.lit(k)) for k in range(4)},
        "address_care_of": blank_to_null(a["care_of"]),
        "address_po_box": blank_to_null(a["po_box"]),
        "address_line_1": blank_to_null(a["address_line_1"]),
        "address_line_2": blank_to_null(a["address_line_2"]),
        "address_post_town": blank_to_null(a["locality"]),
        "address_county": blank_to_null(a["region"]),
        "address_country": blank_to_null(a["country"]),
        "postcode": blank_to_null(a["postal_code"]),
        "registered_address": F.nullif(joined_address(a["care_of"], a["po_box"], a["address_line_1"], a["address_line_2"], a["locality"], a["region"], a["country"]), F.lit("")),
        "incorporation_date": day(p["date_of_creation"]),
        "dissolution_date": day(p["date_of_cessation"]),
        "accounts_ref_day": accounts["accounting_reference_date"]["day"].try_cast("int"),
        "accounts_ref_month": accounts["accounting_reference_date"]["month"].try_cast("int"),
        "accounts_next_due": day(accounts["next_due"]),
        "accounts_last_made_up": day(accounts["last_accounts"]["made_up_to"]),
        "conf_stmt_next_due": day(statement["next_due"]),
        "conf_stmt_last_made_up": day(statement["last_made_up_to"]),
        "is_active": status.isNotNull() & ~F.coalesce(status, F.lit("")).isin(*INACTIVE_STATUSES),
        "record_source": F.lit("api"),
    }


def account_note(directors_known, active_directors, average_age, revenue_source, filing_id, revenue, figures=FILING_FIGURES) -> Column:
    """What is missing of directors and of accounts, one note of each, '; ' between; null if nothing is."""
    source, filed = col(revenue_source), col(filing_id).isNotNull()
    no_figures = F.coalesce(*(col(c).cast("string") for c in figures)).isNull()
    people = ladder((col(directors_known).isNull(), "Directors not fetched"), (col(active_directors) == 0, "No active directors"), (col(average_age).isNull(), "No director dates of birth"))
    accounts = ladder(
        (source == "no_recent_filing", "No accounts filed"),
        (source == "pdf_no_text_layer", "Scanned PDF accounts - figures pending OCR"),
        (~filed, "Accounts not fetched"),
        (source.isNull() & no_figures, "Accounts found but could not be read"),
        (col(revenue).isNull(), "Revenue not in filed accounts"),
    )
    return F.nullif(F.concat_ws("; ", people, accounts), F.lit(""))


def type_decision(company_type) -> tuple[Column, Column]:
    """(include, exclude or review; reason) by the label of the company's type."""
    t = F.nullif(col(company_type), F.lit(""))
    named = lambda text, more="": F.concat(F.lit(text), t, F.lit(more))
    steps = [
        (t.isNull(), "review", F.lit("no company_type available")),
        (t.isin(*INCLUDED_TYPES), "include", named("company_type=")),
        (t.isin(*EXCLUDED_TYPES), "exclude", named("company_type=")),
        *((t.startswith(x), "exclude", F.lit(f"company_type starts with {x}")) for x in EXCLUDED_TYPE_STARTS),
        (t.isin(*RARE_TYPES), "review", named("company_type=", " (rare commercial form)")),
    ]
    return ladder(*((c, d) for c, d, _ in steps), otherwise="review"), ladder(*((c, r) for c, _, r in steps), otherwise=named("unknown company_type="))


def independence(name, owner, charity, brand, company_type) -> tuple[Column, Column]:
    """(decision, reason): owner, charity number, words in the name and brand exclude, in this order; else the company's type decides."""
    lower = F.lower(F.coalesce(col(name), F.lit("")))
    word = F.array_compact(F.array(*(F.when(lower.contains(w), F.lit(w)) for w in DEPENDENT_WORDS)))
    some = lambda c: F.coalesce(col(c).cast("string"), F.lit("")) != ""
    told = lambda text, c, more="": F.concat(F.lit(text), col(c).cast("string"), F.lit(more))
    signs = [
        (F.coalesce(col(owner).isin(*DEPENDENT_OWNERS), F.lit(False)), told("ownership_type=", owner)),
        (some(charity), told("has charity_number=", charity)),
        (F.size(word) > 0, F.concat(F.lit("name contains '"), F.get(word, F.lit(0)), F.lit("'"))),
        (some(brand), told("franchise/chain brand=", brand)),
    ]
    decision, reason = type_decision(company_type)
    return ladder(*((c, "exclude") for c, _ in signs), otherwise=decision), ladder(*signs, otherwise=reason)


def gap_tier(classification, oldest, over_60) -> tuple[Column, Column]:
    """(tier, reason) of an excluded row of the two home-care classes: with supported living Tier 3, else by whether a director is 60 or more."""
    c = col(classification)
    aged = F.coalesce(col(oldest).try_cast("double") >= 60, F.lit(False)) | F.coalesce(col(over_60).try_cast("int") > 0, F.lit(False))
    shown = F.coalesce(col(oldest).cast("string"), F.lit("None"))
    home = c == "Domiciliary Care"
    steps = [
        (c == "Domiciliary Care + Supported Living", "Tier 3", F.lit("Domiciliary Care + Supported Living → Tier 3")),
        (home & aged, "Tier 1", F.concat(F.lit("Domiciliary Care, oldest director="), shown, F.lit(" (≥60)"))),
        (home, "Tier 2", F.concat(F.lit("Domiciliary Care, oldest director="), shown, F.lit(" (<60 or unknown)"))),
    ]
    return ladder(*((k, t) for k, t, _ in steps), otherwise="Excluded"), ladder(*((k, r) for k, _, r in steps), otherwise="unexpected classification")
