"""Nested JSON: people, roles, ratings, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import col

PERSON = "personTitle string, personGivenName string, personFamilyName string"
ACTIVITIES = f"array<struct<nominatedIndividual: struct<{PERSON.replace(' string', ': string')}>>>"
CONTACTS = f"array<struct<{PERSON.replace(' string', ': string')}, personRoles: array<string>>>"
RATINGS = "array<struct<name: string, rating: string>>"
OFFICERS = "array<struct<name: string, officer_role: string, appointed_on: string, resigned_on: string, date_of_birth: struct<year: int, month: int>>>"
KEY_QUESTIONS = ("Safe", "Effective", "Caring", "Responsive", "Well-led")


def field(json, path: str) -> Column:
    """Text at a path; JSON null and a missing path are null."""
    return F.get_json_object(col(json), path)


def part(json, path: str, default: str = "[]") -> Column:
    return F.coalesce(field(json, path), F.lit(default))


def list_length(json, path: str) -> Column:
    return F.coalesce(F.json_array_length(field(json, path)), F.lit(0))


def json_kind(json) -> Column:
    """OBJECT, ARRAY, VARCHAR, NUMBER, BOOLEAN or NULL by the first character; null for what isn't JSON."""
    t = F.trim(col(json))
    c = F.substring(t, 1, 1)
    valid = F.try_parse_json(t).isNotNull()
    return F.when(~valid, None).when(c == "{", "OBJECT").when(c == "[", "ARRAY").when(c == '"', "VARCHAR").when(c.isin("t", "f"), "BOOLEAN").when(c == "n", "NULL").otherwise("NUMBER")


def first_where(array, test) -> Column:
    """First element that passes, in order, or null."""
    return F.try_element_at(F.filter(col(array), test), F.lit(1))


def full_name(person) -> Column:
    """Title, given and family name with spaces; null if all are blank."""
    p = col(person)
    return F.nullif(F.trim(F.concat_ws(" ", p["personTitle"], p["personGivenName"], p["personFamilyName"])), F.lit(""))


def nominated_individual(json) -> Column:
    found = first_where(F.from_json(field(json, "$.regulatedActivities"), ACTIVITIES), lambda a: a["nominatedIndividual"].isNotNull())
    return full_name(found["nominatedIndividual"])


def contact_with_role(json, role: str, path: str = "$.contacts") -> Column:
    """Name of the first contact that has a role, letters' case aside."""
    return full_name(first_where(F.from_json(field(json, path), CONTACTS), lambda c: F.coalesce(F.exists(c["personRoles"], lambda r: F.lower(r) == role.lower()), F.lit(False))))


def _named(name: str):
    return lambda item: item["name"] == name


def ratings(json, path: str) -> dict[str, Column]:
    """A column for each key question."""
    listed = F.from_json(field(json, path), RATINGS)
    return {"rating_" + q.lower().replace("-", "_"): first_where(listed, _named(q))["rating"] for q in KEY_QUESTIONS}


def active_directors(officers) -> Column:
    """Officers with 'director' in the role and no resignation date."""
    return F.filter(col(officers), lambda o: (F.coalesce(o["resigned_on"], F.lit("")) == "") & F.lower(F.coalesce(o["officer_role"], F.lit(""))).contains("director"))


def birth_years(directors) -> Column:
    return F.array_compact(F.transform(col(directors), lambda o: o["date_of_birth"]["year"]))


def age_facts(years, as_of_year: int) -> dict[str, Column]:
    """Average (cut to an integer), least and greatest age, how many are 60 or more, and whether all are; none known: null, null, null, 0, false."""
    ages = F.transform(F.coalesce(col(years), F.array().cast("array<int>")), lambda y: F.lit(as_of_year) - y)
    n = F.size(ages)
    total = F.aggregate(ages, F.lit(0).cast("long"), lambda a, b: a + b)
    return {
        "avg_director_age": F.when(n > 0, F.floor(total / n).cast("int")),
        "min_director_age": F.array_min(ages),
        "max_director_age": F.array_max(ages),
        "directors_over_60": F.size(F.filter(ages, lambda a: a >= 60)),
        "all_directors_60_plus": (n > 0) & F.forall(ages, lambda a: a >= 60),
    }


def directors_json(directors) -> Column:
    return F.to_json(F.transform(col(directors), lambda o: F.struct(o["name"].alias("name"), o["officer_role"].alias("officer_role"), o["appointed_on"].alias("appointed_on"), o["date_of_birth"].alias("date_of_birth"))), {"ignoreNullFields": "false"})


def directors_text(directors, as_of_year: int) -> Column:
    """'Name (age); Name' in order."""
    return F.array_join(F.transform(col(directors), lambda o: F.concat(F.coalesce(o["name"], F.lit("")), F.coalesce(F.concat(F.lit(" ("), (F.lit(as_of_year) - o["date_of_birth"]["year"]).cast("string"), F.lit(")")), F.lit("")))), "; ")


def aligned(values, others) -> Column:
    """Second list where both have the same length, so that positions correspond; else null."""
    return F.when(F.size(col(values)) == F.size(col(others)), col(others))


def over_age(years, least: int, as_of_year: int) -> tuple[Column, Column]:
    """How many are `least` or older, and whether all are (of one or more)."""
    ages = F.transform(col(years), lambda y: F.lit(as_of_year) - y)
    return F.size(F.filter(ages, lambda a: a >= least)), (F.size(ages) > 0) & F.forall(ages, lambda a: a >= least)


def nth(array, k: int) -> Column:
    """Element at a position from 0, null beyond the end."""
    return F.get(col(array), F.lit(k))


def first_annual_accounts(json) -> Column:
    """First filing of a list that is annual accounts."""
    items = F.from_json(field(json, "$.items"), "array<struct<type: string, description: string, date: string, transaction_id: string, paper_filed: boolean, links: struct<document_metadata: string>, description_values: struct<made_up_date: string>>>")
    return first_where(items, lambda i: (F.upper(F.coalesce(i["type"], F.lit(""))).isin("AA", "AAMD") | F.coalesce(i["description"], F.lit("")).rlike("^accounts-(amended-)?with-accounts-type-")) & (F.trim(F.coalesce(i["transaction_id"], F.lit(""))) != "") & (F.trim(F.coalesce(i["links"]["document_metadata"], F.lit(""))) != ""))
