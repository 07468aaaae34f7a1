"""Columns computed again from stored answers, without asking anyone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nested
from ..functions.codes import flag, flagged_names, registry_number
from .grouping import latest
from .merges import insert_replace


def directors(answers: DataFrame, stored: DataFrame, as_of_year: int, at) -> DataFrame:
    """Stored figures with the director columns of each company's latest good officer answer; companies that weren't stored come in."""
    good = answers.where("entity_type = 'ch_directors' and http_status = 200")
    rows = latest(good, "entity_id", "fetched_at", "response_id").select(registry_number("entity_id").alias("company_number"), F.from_json("raw_json", nested.OFFICERS).alias("_o"))
    rows = rows.withColumn("_active", nested.active_directors("_o")).withColumn("_years", nested.birth_years("_active"))
    new = rows.select(
        "company_number",
        nested.directors_json("_active").alias("directors"),
        F.size("_active").alias("total_active_directors"),
        F.to_json("_years").alias("directors_dob_years"),
        *(v.alias(c) for c, v in nested.age_facts("_years", as_of_year).items()),
        F.lit(at).cast("timestamp").alias("last_enriched_at"),
    )
    return insert_replace(stored, new, ["company_number"])


def director_counts(updated: DataFrame) -> DataFrame:
    """One row: how many have a known age, and how many have none."""
    none = F.col("avg_director_age").isNull()
    return updated.agg(F.count("*").alias("records_updated"), F.count_if(~none).alias("enriched"), F.count_if(none).alias("no_active_directors"))


def key_question_ratings(rows: DataFrame, json: str = "current_ratings", path: str = "$.overall.keyQuestionRatings") -> DataFrame:
    """`rows` with the five key-question ratings read again from their stored answer."""
    return rows.withColumns(nested.ratings(json, path))


def row_flags(rows: DataFrame, groups: dict[str, dict[str, str]], raw: str = "raw_row") -> DataFrame:
    """`rows` with a JSON list for each group (column to {shown name: key in the stored row}) of the names whose value is a yes, in the given order."""
    value = lambda key: flag(F.try_element_at(F.from_json(raw, "map<string,string>"), F.lit(key)))
    return rows.withColumns({column: F.to_json(flagged_names({name: value(key) for name, key in names.items()})) for column, names in groups.items()})
