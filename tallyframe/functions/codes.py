"""Row-level cleaning of codes, names, numbers and dates, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a company name key leaves out, in a mild and in an aggressive form.
NOISE_WORDS = ("ltd", "limited", "plc", "llp", "the", "uk")
AGGRESSIVE_NOISE_WORDS = (*NOISE_WORDS, "care", "services")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def leading_code(c) -> Column:
    """Digits at the start of a labelled code ('88100 - Social work' gives 88100), else null."""
    return F.nullif(F.regexp_extract(col(c), r"^\s*(\d+)", 1), F.lit(""))


def joined_address(*parts) -> Column:
    """Non-blank parts with ', ' between; '' if there is none."""
    return F.concat_ws(", ", *(blank_to_null(p) for p in parts))


def registry_number(c) -> Column:
    """White space out, upper case, all-digit numbers padded to eight; longer ones stay whole; blank gives null."""
    t = F.regexp_replace(F.upper(F.coalesce(col(c).cast("string"), F.lit(""))), r"\s+", "")
    return F.when(t == "", None).when(t.rlike("^[0-9]+$") & (F.length(t) < 8), F.lpad(t, 8, "0")).otherwise(t)


def listed_number(c) -> Column:
    """A number from a user's list: up to eight digits padded, or one or two letters with digits padded to eight in all; anything else null.

    '1234567.0' counts as an integer, '1234567.5' doesn't.
    """
    t = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(col(c).cast("string"), F.lit(""))), r"\s+", ""), r"^(\d+)\.0+$", "$1")
    letters, digits = F.regexp_extract(t, r"^([A-Z]{1,2})\d+$", 1), F.regexp_extract(t, r"^[A-Z]{1,2}(\d+)$", 1)
    room = F.lit(8) - F.length(letters)
    prefixed = F.concat(letters, F.repeat(F.lit("0"), room - F.length(digits)), digits)
    return F.when(t.rlike(r"^\d{1,8}$"), F.lpad(t, 8, "0")).when((letters != "") & (F.length(digits) <= room), prefixed)


def loose_number(c) -> Column:
    """As registry_number, also for exports that turned numbers to floats: a trailing '.0' goes, 'NAN' and 'NONE' are null."""
    t = F.regexp_replace(F.upper(F.trim(F.coalesce(col(c).cast("string"), F.lit("")))), r"\.0$", "")
    return registry_number(F.when(t.isin("NAN", "NONE", ""), None).otherwise(t))


def outward_code(c) -> Column:
    """Postcode without its last three characters; four characters or fewer are an outward code already."""
    t = F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), r"\s+", "")
    return F.when(t == "", None).when(F.length(t) <= 4, t).otherwise(t.substr(F.lit(1), F.length(t) - 3))


def area_prefix(c) -> Column:
    """Leading area and district by pattern ('M11AE' gives M11, where outward_code gives M1); '' where there is none."""
    return F.regexp_extract(F.upper(F.trim(col(c))), r"^([A-Z]{1,2}[0-9][A-Z0-9]?)", 1)


def words_of(c) -> Column:
    return F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != "")


def name_key(c, aggressive: bool = False) -> Column:
    """Lower-case words of a name without noise words, marks read as spaces."""
    noise = F.array(*map(F.lit, AGGRESSIVE_NOISE_WORDS if aggressive else NOISE_WORDS))
    cleaned = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9 ]+", " ")
    return F.array_join(F.filter(words_of(cleaned), lambda w: ~F.array_contains(noise, w)), " ")


def clean_text(c) -> Column:
    """Trimmed; '', '-' and '*' are null."""
    t = F.trim(col(c))
    return F.when(~t.isin("", "-", "*"), t)


def flag(c) -> Column:
    """Y, YES, TRUE and 1 are true, all else false, null too."""
    return F.upper(F.trim(F.coalesce(col(c).cast("string"), F.lit("")))).isin("Y", "YES", "TRUE", "1")


def tri_state(c) -> Column:
    """Y-like values true, N-like values false, anything else null."""
    t = F.upper(F.trim(col(c)))
    return F.when(t.isin("Y", "YES", "TRUE", "1"), True).when(t.isin("N", "NO", "FALSE", "0"), False)


def whole_number(c) -> Column:
    """Integer part of a number with thousands commas, else null."""
    return F.regexp_replace(F.trim(col(c)), ",", "").try_cast("double").try_cast("bigint").try_cast("int")


def account_number(c) -> Column:
    """Amount in accounts: commas and spaces out, brackets negative."""
    t = F.regexp_replace(col(c), r"[,\s]", "")
    inner = F.regexp_extract(t, r"^\((.*)\)$", 1)
    return F.when(inner != "", -inner.try_cast("double")).otherwise(t.try_cast("double"))


def headcount(c, most: int = 999_999) -> Column:
    """Whole, positive, and null beyond what is plausible."""
    n = F.abs(col(c).try_cast("double").try_cast("bigint"))
    return F.when(n <= most, n.cast("int"))


def flagged_names(flags: dict[str, Column | str]) -> Column:
    """Names of the true flags, in the given order."""
    return F.array_compact(F.array(*(F.when(col(c), F.lit(name)) for name, c in flags.items())))


def sorted_json(*names: str) -> Column:
    """Row as JSON with keys in ascending order, nulls written out."""
    return F.to_json(F.struct(*(F.col(n) for n in sorted(names))), {"ignoreNullFields": "false"})


def labelled(c, labels: dict[str, str]) -> Column:
    """Label of a code; an unknown code has its hyphens read as spaces and its first letter raised."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    plain = F.regexp_replace(col(c), "-", " ")
    return F.coalesce(known[col(c)], F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 2**30)))


def parsed_date(c) -> Column:
    """Day/month/year, else ISO, else null."""
    return F.coalesce(F.try_to_timestamp(col(c), F.lit("d/M/yyyy")).cast("date"), col(c).try_cast("date"))


def whole_months(since, until) -> Column:
    """Completed months between two dates, 0 at least."""
    a, b = col(since), col(until)
    n = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")
    return F.greatest(n, F.lit(0))


def age_in_year(birth_year, as_of) -> Column:
    return F.year(col(as_of)) - col(birth_year)


def years_between(since, until) -> Column:
    return F.datediff(col(until), col(since)) / F.lit(365.25)


def stale(c, as_of, months: int = 1) -> Column:
    """Null or earlier than `months` months before `as_of`."""
    return F.coalesce(col(c) < F.add_months(col(as_of), -months), F.lit(True))


def stale_days(c, as_of, days: int = 30) -> Column:
    return F.coalesce(col(c) < F.date_sub(col(as_of), days), F.lit(True))


def percent_change(now, before) -> Column:
    """100 |now - before| / before to two places; null before nothing."""
    b = col(before).cast("double")
    return F.round(F.lit(100.0) * F.abs(col(now).cast("double") - b) / F.nullif(b, F.lit(0.0)), 2)


def sum_unless_null(*columns) -> Column:
    """Sum of what is there; null if nothing is."""
    cs = [col(c) for c in columns]
    return F.when(F.coalesce(*cs).isNotNull(), reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in cs)))
