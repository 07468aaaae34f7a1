"""The headline query: companies scored and tiered from their best match, classification, ages and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import age_points, class_points, service_points, size_points, tier
from .grouping import best_match, current_classification


def service_mix(matches: DataFrame, sites: DataFrame) -> DataFrame:
    """Which services a matched provider's sites offer, active or not."""
    has = lambda *texts: F.bool_or(F.array_max(F.array(*(F.col("service_types").contains(t) for t in texts))))
    return matches.select("company_number", "provider_id").join(sites.select("provider_id", "service_types"), "provider_id").groupBy("company_number").agg(
        has("Homecare").alias("has_homecare"), has("Supported living").alias("has_supported_living"), has("Residential", "Nursing home").alias("has_residential")
    )


def excluded(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Companies on an active exclusion list."""
    return members.join(lists.where("is_active").select("list_name"), "list_name", "left_semi").select("company_number").distinct()


def not_excluded(companies: DataFrame, out: DataFrame) -> DataFrame:
    """Companies that aren't in `out`, as NOT IN has it: a null in `out` excludes all, and a company without a number stays only if `out` is empty."""
    state = out.agg(F.count("*").alias("_all"), F.count("company_number").alias("_known"))
    left = companies.join(out.where("company_number is not null"), "company_number", "left_anti").join(F.broadcast(state))  # one row
    return left.where("_all = 0 or (_all = _known and company_number is not null)").drop("_all", "_known")


def scored(base: DataFrame) -> DataFrame:
    """Points, total and tier over verdict, service flags, ages and revenue columns."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = base.withColumns(
        {
            "class_pts": class_points("verdict"),
            "service_pts": service_points(flag("has_homecare"), flag("has_supported_living"), flag("has_residential")),
            "age_pts": age_points("avg_director_age", "directors_over_60", "all_directors_60_plus"),
            "size_pts": size_points("revenue"),
        }
    )
    rows = rows.withColumn("effective_class_pts", F.greatest("class_pts", "service_pts"))
    rows = rows.withColumn("total_score", F.col("effective_class_pts") + F.col("age_pts") + F.col("size_pts"))
    return rows.withColumn("tier", tier("total_score", "effective_class_pts"))


def tiered_targets(companies: DataFrame, matches: DataFrame, sites: DataFrame, matched_sites: DataFrame, enrichment: DataFrame, classifications: DataFrame, exclusions: DataFrame, lists: DataFrame) -> DataFrame:
    """Companies with a match and no exclusion, scored and tiered."""
    best = best_match(matches, matched_sites).withColumnsRenamed({"status": "match_status", "total_score": "match_score"})
    verdicts = current_classification(classifications).select("company_number", "verdict", F.col("source_type").alias("classification_source"), "sources_agreement")
    base = not_excluded(companies.join(best, "company_number"), excluded(exclusions, lists))
    return scored(base.join(enrichment, "company_number", "left").join(verdicts, "company_number", "left").join(service_mix(best, sites), "company_number", "left"))


def tier_filter(df: DataFrame, tiers: tuple[str, ...] | None = ("Tier 1", "Tier 2", "Tier 3")) -> DataFrame:
    """The default hides what is excluded; None or nothing is all."""
    return df.where(F.col("tier").isin(*tiers)) if tiers else df
