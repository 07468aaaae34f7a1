"""Facts of tagged accounts documents: which one of several stands for a figure.

Input rows: doc_id, name, value (double), instant, startdate, enddate (date), members (array<string>: local names of the
dimension members, empty for a fact of the whole entity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import col
from .grouping import first_by


def local_members(segments) -> Column:
    """Local names of the members: of each text the third word on, without the prefix; a blank text names none."""
    last = lambda s: F.element_at(F.split(F.element_at(F.split(F.trim(s), r"\s+", 3), -1), ":"), -1)
    return F.transform(F.filter(col(segments), lambda s: F.trim(F.coalesce(s, F.lit(""))) != ""), last)


def end_of(instant: bool = False) -> Column:
    return F.col("instant") if instant else F.coalesce("enddate", "instant")


def _order(names: list[str], instant: bool) -> list[Column]:
    days = F.datediff("enddate", "startdate")
    return [F.array_position(F.array(*map(F.lit, names)), F.col("name")), (F.size("members") > 0), end_of(instant).desc_nulls_last(), days.desc_nulls_last(), F.col("value").desc()]


def pick(facts: DataFrame, names: list[str], instant: bool = False) -> DataFrame:
    """One fact a document: earliest name in the list, whole entity before segments, latest date, longest period; the larger value on ties."""
    return first_by(facts.where(F.col("name").isin(names) & F.col("value").isNotNull()), "doc_id", *_order(names, instant))


def balance_sheet_dates(facts: DataFrame) -> DataFrame:
    return facts.groupBy("doc_id").agg(F.max("instant").alias("balance_sheet_date"))


def at_balance_sheet(facts: DataFrame, names: list[str], allowed: list[str] | None = None, need_member: bool = False) -> DataFrame:
    """`pick` among facts at the document's latest instant; with `allowed`, every member of a fact must be in it."""
    rows = facts.join(balance_sheet_dates(facts), "doc_id").where("instant = balance_sheet_date")
    if allowed is not None:
        inside = F.size(F.array_except("members", F.array(*map(F.lit, allowed)).cast("array<string>"))) == 0
        rows = rows.where(inside & ((F.size("members") > 0) if need_member else F.lit(True)))
    return pick(rows, names, instant=True).drop("balance_sheet_date")


def period_bounds(facts: DataFrame, revenue: list[str], balance: list[str], groups: list[list[str]]) -> DataFrame:
    """(doc_id, period_start, period_end): from the revenue fact; else from period facts that end at the balance-sheet fact's date, group by group, then any such
    duration, then that date alone; without a balance-sheet fact, from period facts of any date, then any duration."""
    known = facts.where("value is not null")
    anchor = pick(facts, balance, instant=True).select("doc_id", end_of(True).alias("_anchor"))
    rows = known.join(anchor, "doc_id", "left").withColumn("_end", end_of())
    spans = [(0, F.col("name").isin(revenue), revenue)]
    at_anchor = F.col("_anchor").isNull() | (F.col("_end") == F.col("_anchor"))
    spans += [(k + 1, F.col("name").isin(g) & at_anchor, g) for k, g in enumerate(groups)]
    spans += [(len(groups) + 1, (F.col("startdate").isNotNull() | F.col("enddate").isNotNull()) & at_anchor, [])]
    tagged = rows.withColumn("_use", F.explode(F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("k"), (F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("name"))).alias("r"))) for k, c, names in spans)))))
    tagged = tagged.where("startdate is not null or _end is not null")
    best = first_by(tagged, "doc_id", F.col("_use.k"), F.col("_use.r"), (F.size("members") > 0), F.col("_end").desc_nulls_last(), F.datediff("_end", "startdate").desc_nulls_last(), F.col("value").desc())
    docs = facts.select("doc_id").distinct().join(best.select("doc_id", F.col("startdate").alias("period_start"), F.col("_end").alias("period_end")), "doc_id", "left").join(anchor, "doc_id", "left")
    return docs.select("doc_id", "period_start", F.coalesce("period_end", "_anchor").alias("period_end"))


def staff(value, shown, scale) -> Column:
    """Head count: the displayed text where the tag has a negative scale."""
    return F.when(col(scale) < 0, F.regexp_replace(col(shown), ",", "").try_cast("double")).otherwise(col(value))


def liability(value) -> Column:
    return F.abs(col(value))
