"""Reads of care places and providers: filter sets, the joined view with companies, scope by service, and look-ups with a second key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import name_key, registry_number
from .reading import any_text, at_least, at_most, both, contains_any_case, equals, list_has_any, presence, starts


def _several(values: str | list[str] | None) -> list[str] | None:
    """One text, several, or none."""
    return [values] if isinstance(values, str) and values else list(values) if values else None


def _one_of(column: str, values) -> Column | None:
    wanted = _several(values)
    return F.col(column).isin(wanted) if wanted else None


def location_filter(name_contains=None, service_types=None, regions=None, local_authorities=None, provider_name_contains=None, postcode_prefix=None, is_active=None) -> Column:
    """Conjunction of the filters that are given, over a row a place; several values of one filter are alternatives."""
    return both(
        contains_any_case(["name"], name_contains),
        any_text("service_types", _several(service_types)),
        _one_of("region", regions),
        _one_of("local_authority", local_authorities),
        contains_any_case(["provider_name"], provider_name_contains),
        starts("postcode", postcode_prefix),
        equals("is_active", is_active),
    )


def provider_filter(provider_name_contains=None, service_types=None, regions=None, local_authorities=None, is_active=None, min_active_location_count=None, max_active_location_count=None) -> Column:
    """As `location_filter`, over the list columns of a row a provider."""
    return both(
        contains_any_case(["provider_name"], provider_name_contains),
        list_has_any("service_types_list", _several(service_types)),
        list_has_any("regions_list", _several(regions)),
        list_has_any("local_authorities_list", _several(local_authorities)),
        equals("is_active", is_active),
        at_least("active_location_count", min_active_location_count),
        at_most("active_location_count", max_active_location_count),
    )


def with_companies(listed: DataFrame, places: DataFrame, companies: DataFrame, has_number: bool | None = None, **filters) -> DataFrame:
    """Listed places that are places (inner), with the company of the listed number where there is one (left), under the filters of a place."""
    wanted = presence("provider_companies_house_number", has_number)
    rows = listed if wanted is None else listed.where(wanted)
    found = rows.join(places.where(location_filter(**filters)), "location_id")
    return found.join(companies.withColumnRenamed("company_number", "provider_companies_house_number"), "provider_companies_house_number", "left")


def in_scope(providers: DataFrame, listed: DataFrame, relevant: Column) -> DataFrame:
    """Active providers with a listed place of a relevant service; however many such places, a provider is one row."""
    return providers.where("is_active").join(listed.where(relevant).select("provider_id"), "provider_id", "left_semi")


def over_60_filter(flag: bool | None, column: str = "directors_over_60") -> Column | None:
    """Only True filters; False is as None."""
    return F.col(column) > 0 if flag else None


def postcode_key(c) -> Column:
    return F.nullif(F.regexp_replace(F.upper(F.coalesce(F.col(c), F.lit(""))), r"\s+", ""), F.lit(""))


def by_number_or_place(rows: DataFrame, known: DataFrame, value: str, number: str = "company_number", name: str = "provider_name", postcode: str = "postcode") -> DataFrame:
    """`rows` with `value` of `known` found by number, else by name key and postcode together; `found` says whether either hit.

    Both look-ups are equi-joins on one row a key: of several known rows of one key, the least value counts.  A blank name key finds nothing.
    """
    keyed = known.select(registry_number(number).alias("_number"), F.nullif(name_key(name), F.lit("")).alias("_name"), postcode_key(postcode).alias("_place"), F.col(value).alias("_value"))
    one = lambda *keys: keyed.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.min("_value").alias("_v"), F.lit(True).alias("_hit"))
    by_number, by_place = one("_number").withColumnsRenamed({"_v": "_v1", "_hit": "_h1"}), one("_name", "_place").withColumnsRenamed({"_v": "_v2", "_hit": "_h2"})
    marked = rows.withColumns({"_number": registry_number(number), "_name": F.nullif(name_key(name), F.lit("")), "_place": postcode_key(postcode)})
    joined = marked.join(by_number, "_number", "left").join(by_place, ["_name", "_place"], "left")
    return joined.select(*rows.columns, F.when(F.col("_h1"), F.col("_v1")).otherwise(F.col("_v2")).alias(value), F.coalesce("_h1", "_h2", F.lit(False)).alias("found"))
