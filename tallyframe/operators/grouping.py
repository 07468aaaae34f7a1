"""Aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.codes import area_prefix
from ..functions.scores import agreement


SKETCH = 10_000  # accuracy of the sketch that brackets a rank
FEW = 20_000  # rows of a table of groups that may go along with each task


def first_by(df: DataFrame, keys: list[str] | str, *order: Column) -> DataFrame:
    """One row a key: the first by `order`, which should end in a unique column."""
    keys = [keys] if isinstance(keys, str) else keys
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def ranked(column: str, ranks: list[str]) -> Column:
    """Position of a value in a list from 1, 99 if it isn't there."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ranks)), F.col(column)), F.lit(0)), F.lit(99))


def best_match(matches: DataFrame, sites: DataFrame, company: str = "company_number", provider: str = "provider_id") -> DataFrame:
    """Best match a company: status, score, time, number of the provider's sites, then provider id."""
    statuses = ["user_confirmed", "auto_confirmed", "needs_review"]
    count = sites.groupBy(provider).agg(F.count("*").alias("_sites"))
    rows = matches.where(F.col("status").isin(statuses)).join(count, provider, "left")
    return first_by(rows, company, ranked("status", statuses), F.desc("total_score"), F.desc("matched_at"), F.desc(F.coalesce("_sites", F.lit(0))), F.col(provider)).drop("_sites")


def current_classification(rows: DataFrame, company: str = "company_number") -> DataFrame:
    """Best-ranked verdict a company with how many sources there are and whether they agree."""
    order = ["manual", "website", "cqc_service_type", "cqc_specialism", "rule"]
    whole = Window.partitionBy(company)
    counted = rows.withColumns({"source_count": F.count("*").over(whole), "distinct_verdicts": F.size(F.collect_set("verdict").over(whole)).cast("long")})
    best = first_by(counted, company, ranked("source_type", order), F.desc("classified_at"), F.col("verdict").asc_nulls_last())
    return best.withColumn("sources_agreement", agreement("source_count", "distinct_verdicts"))


def latest(df: DataFrame, keys: list[str] | str, time: str, tie: str) -> DataFrame:
    return first_by(df, keys, F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last())


def primary_flags(candidates: DataFrame, existing: DataFrame, key: str, *order: Column) -> DataFrame:
    """Flag the first candidate of each key that has no primary yet."""
    have = existing.where("is_primary").select(F.col(key).alias("_have")).distinct()
    ranked_rows = candidates.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked_rows.join(have, F.col(key) == F.col("_have"), "left").withColumn("is_primary", (F.col("_rank") == 1) & F.col("_have").isNull()).drop("_rank", "_have")


def rollup(sites: DataFrame, key: str = "provider_id") -> DataFrame:
    """A row a provider from its sites, in one aggregation: counts, dates, most frequent name (least on ties), sorted distinct lists over active sites."""
    active = F.coalesce(F.col("is_active"), F.lit(False))
    some = lambda c: active & (F.coalesce(F.col(c), F.lit("")) != "")
    listed = lambda c, value=None: F.array_sort(F.collect_set(F.when(some(c), F.col(c) if value is None else value)))
    services = F.collect_set(F.when(some("service_types"), F.col("service_types")))
    split = F.array_distinct(F.flatten(F.transform(services, lambda s: F.transform(F.split(s, r"\|"), lambda x: F.trim(x)))))
    return sites.groupBy(key).agg(
        F.mode("provider_name", True).alias("provider_name"),
        F.count_if(active).alias("active_location_count"),
        F.count("*").alias("total_location_count"),
        F.array_sort(F.array_remove(split, "")).alias("service_types_list"),
        listed("region").alias("regions_list"),
        listed("postcode", area_prefix("postcode")).alias("postcode_prefixes_list"),
        listed("local_authority").alias("local_authorities_list"),
        F.min("first_scrape_date").alias("first_scrape_date"),
        F.max("last_scrape_date").alias("last_scrape_date"),
        F.bool_or("is_active").alias("is_active"),
        F.when(F.bool_or("is_active"), None).otherwise(F.max("marked_inactive_scrape_date")).alias("marked_inactive_scrape_date"),
    )


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last())


def top_values(df: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    """Most frequent non-null values over several columns, one pass; ties by value."""
    values = df.select(F.explode(F.array_compact(F.array(*(F.col(c).cast("string") for c in columns)))).alias("code"))
    return values.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(k)


def duplicate_keys(df: DataFrame, key: str, sample: int = 5) -> DataFrame:
    """One row: how many keys repeat, how many rows too many there are, and the least few such keys."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return twice.agg(F.count("*").alias("dup_distinct"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dup_excess")).crossJoin(
        twice.orderBy(key).limit(sample).agg(F.array_sort(F.collect_list(F.col(key))).alias("dup_sample"))
    )


def joined_distinct(df: DataFrame, keys: list[str], value: str, order: str, most: int) -> DataFrame:
    """Distinct values a group in first-seen order, '; ' between, with '(+N more)' after `most`."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_at"))
    place = Window.partitionBy(*keys).orderBy("_at", value)
    placed = firsts.withColumn("_k", F.row_number().over(place))
    kept = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.struct("_k", F.col(value).cast("string").alias("v"))))).alias("_v"), F.count("*").alias("_n"))
    text = F.array_join(F.transform("_v", lambda x: x["v"]), "; ")
    return kept.select(*keys, F.when(F.col("_n") > most, F.concat(text, F.lit(" (+"), (F.col("_n") - most).cast("string"), F.lit(" more)"))).otherwise(text).alias("joined"))


def merged_groups(df: DataFrame, number: str, fallback: str, order: str, firsts: list[str], flags: list[str]) -> DataFrame:
    """Rows merged by number, else by the fallback id: first non-empty value, any flag, and the row count."""
    key = F.when(F.col(number).isNotNull(), F.concat(F.lit("n:"), F.col(number).cast("string"))).otherwise(F.concat(F.lit("p:"), F.col(fallback).cast("string")))
    filled = lambda c: F.min_by(F.nullif(F.col(c).cast("string"), F.lit("")), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order)))
    return df.groupBy(key.alias("merge_key")).agg(F.count("*").alias("n_rows"), *(filled(c).alias(c) for c in firsts), *(F.bool_or(c).alias(c) for c in flags))


def small(df: DataFrame) -> DataFrame:
    """`df`, written once, to go along with each task if it has at most FEW rows; a larger one is joined by a shuffle."""
    held = cut(df)
    return F.broadcast(held) if held.limit(FEW + 1).count() <= FEW else held


def exact_quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles (name to point), exact, with n; a row a group, nulls left out.

    No task holds a group's values: a sketch brackets each wanted rank between two values, what lies below the bracket is only
    counted, and the values inside, a few in SKETCH of a group, are put in order.  A group of at most 10 * SKETCH values is put in order whole.
    """
    x = df.select(*keys, F.col(value).cast("double").alias("_x")).where("_x is not null")
    near = [min(1.0, max(0.0, q + d)) for q in points.values() for d in (-2.0 / SKETCH, 2.0 / SKETCH)]
    sketch = x.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_x", near, SKETCH).alias("_s"))
    edge = lambda k, none: F.when(F.col("n") > 10 * SKETCH, F.col("_s")[k]).otherwise(F.lit(none))
    ranks = [F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("rank"), edge(2 * k, float("-inf")).alias("lo"), edge(2 * k + 1, float("inf")).alias("hi")) for k, (name, q) in enumerate(points.items())]
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    wanted = small(sketch.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "n", F.array(*ranks).alias("_w")))
    pairs = x.join(wanted, same) if keys else x.join(wanted)  # without keys: one row
    pairs = pairs.select(*keys, "_x", "n", F.explode("_w").alias("w")).select(*keys, "_x", "n", "w.*").where("_x <= hi")
    counted = pairs.groupBy(*keys, "name", F.when(F.col("_x") >= F.col("lo"), F.col("_x")).alias("_x")).agg(F.count("*").alias("c"), F.first("rank").alias("rank"), F.first("n").alias("n"))
    placed = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "name").orderBy(F.col("_x").asc_nulls_first())))
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("_x")))
    low, high, part = at(F.floor("rank")), at(F.ceil("rank")), F.first(F.col("rank") - F.floor("rank"))
    found = placed.groupBy(*keys, "name").agg((low + part * (high - low)).alias("v"), F.first("n").alias("n"))
    return found.groupBy(*keys).agg(F.first("n").alias("n"), *(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in points))


def grouped_runs(df: DataFrame, key: str, *order: str) -> DataFrame:
    """A row a key with its rows' other columns as a list of structs in order, as reading the ordered rows key by key gives them; one key's rows are meant to be few."""
    rest = [c for c in df.columns if c != key]
    first = [c for c in order if c in rest]
    item = F.struct(*first, *(c for c in rest if c not in first))
    return df.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("rows"))


def log_mad(df: DataFrame, keys: list[str], value: str, least: int = 8) -> DataFrame:
    """Median and scaled median absolute deviation of the logs of positive values, by group; null under `least` values."""
    logs = df.where(F.col(value) > 0).select(*keys, F.log(value).alias("_x"))
    mid = exact_quantiles(logs, keys, "_x", {"median_log": 0.5})
    mid = cut(mid)
    away = logs.join(small(mid), keys).select(*keys, F.abs(F.col("_x") - F.col("median_log")).alias("_x"))
    spread = exact_quantiles(away, keys, "_x", {"mad": 0.5}).drop("n")
    scaled = F.when(F.col("mad") == 0, 1e-9).otherwise(F.col("mad")) * 1.4826
    enough = F.col("n") >= least
    return mid.join(spread, keys).select(*keys, "n", F.when(enough, F.col("median_log")).alias("median_log"), F.when(enough, scaled).alias("mad_log"))


def percentiles(df: DataFrame, keys: list[str], value: str, points=(0.05, 0.5, 0.95, 0.99)) -> DataFrame:
    """Linearly interpolated percentiles."""
    return exact_quantiles(df, keys, value, {f"p{round(100 * q)}": q for q in points}).drop("n")


def suspicion(weights: list[tuple[Column, int, str]]) -> tuple[Column, Column, Column]:
    """Sum of the weights of what holds, the names of what holds, and a bucket of the sum."""
    score = sum((F.when(c, w).otherwise(0) for c, w, _ in weights), F.lit(0))
    signals = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, _, n in weights)))
    return score, signals, F.when(score == 0, "clean").when(score < 3, "minor").when(score < 6, "review").otherwise("suspicious")


def next_id(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_id"))


def with_ids(new: DataFrame, existing: DataFrame, id_col: str, *order: Column) -> DataFrame:
    """Surrogate ids after the largest one in use, in a stated order, which has to end in something unique.

    The rows are sorted over all tasks; each task numbers its own, after the counts of those before it, of which there is one a task.
    """
    placed = cut(new.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    before = sizes.withColumn("_before", F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).drop("_c")
    start = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_start"))
    numbered = placed.join(F.broadcast(before), "_part").join(F.broadcast(start))  # a row a task, and one row
    return numbered.withColumn(id_col, F.col("_start") + F.col("_before") + (F.col("_at") - F.col("_first")) + 1).drop("_part", "_at", "_first", "_before", "_start")
