"""Latest-wins merges: inserts that ignore or replace, and the merge of filed figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import ladder
from .grouping import first_by

MOST_BANDS = 10_000
# The figures of a filing.
FIGURES = (
    "revenue", "employee_count", "filing_period_start", "filing_period_end", "gross_profit", "profit_before_tax", "profit_after_tax", "fixed_assets",
    "current_assets", "total_assets", "net_assets", "net_current_assets", "debtors", "creditors_within_one_year", "creditors_after_one_year",
    "provisions_for_liabilities", "deferred_tax", "filing_id", "filing_format", "filing_age_months",
)
# The states of a parsed filing and the sources of a revenue figure.
FAILED = ("request_error", "document_metadata_error", "document_download_error", "no_document_resource", "ixbrl_parse_error", "pdf_parse_error")
OCR_SOURCES = ("filed_accounts_ocr_pdf", "partial_ocr_no_pl", "filed_accounts_pdf_ocr")
FILED_SOURCES = ("filed_accounts_ixbrl", "filed_accounts_pdf", "filed_accounts_ocr_pdf")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is new; of new rows with equal keys the one of least values stays, column by column in their order."""
    fresh = one_a_key(new, keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def one_a_key(new: DataFrame, keys: list[str], greatest: bool = False) -> DataFrame:
    """One row a key, the least (or greatest) one by its other columns in order; nulls are least."""
    rest = [c for c in new.columns if c not in keys]
    if not rest:
        return new.dropDuplicates(keys)
    pick = F.max if greatest else F.min
    row = F.struct(*(f for c in rest for f in (F.col(c).isNotNull().alias(f"has_{c}"), F.col(c).alias(c))))
    return new.groupBy(*keys).agg(pick(row).alias("_row")).select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in new.columns))


def insert_replace(old: DataFrame, new: DataFrame, keys: list[str], listed: list[str] | None = None) -> DataFrame:
    """New rows replace old ones of their key in the listed columns (all of theirs); other columns keep the old values.

    Of new rows with equal keys the one of greatest values counts, column by column in their order, so that each key stays one row.
    """
    new = one_a_key(new, keys, greatest=True)
    listed = [c for c in (listed or new.columns) if c not in keys]
    right = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in listed), F.lit(True).alias("_new"))
    joined = old.join(right, keys, "full_outer")
    columns = old.columns + [c for c in listed if c not in old.columns]
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(c) if c in old.columns else F.lit(None)) if c in listed else F.col(c)
    return joined.select(*(value(c).alias(c) for c in columns))


def latest_staged(staged: DataFrame, key: str, time: str, *ties: str) -> DataFrame:
    return first_by(staged, key, F.col(time).desc_nulls_last(), *(F.col(t).asc_nulls_last() for t in ties))


def merge_figures(stored: DataFrame, staged: DataFrame, key: str = "company_number") -> DataFrame:
    """Merge parsed filings into stored figures: the latest staged row of each key, in one of three modes.

    A row that parsed a filing replaces all figures, nulls too, so that none of an older filing stays beside them.  A filing
    that came again without a text layer leaves figures that OCR recovered from it.  Other rows only fill gaps.  Stored
    columns that aren't figures stay; rows without a staged one stay as they are.
    """
    rows = latest_staged(staged, key, "fetched_at", "filing_id")
    new = rows.select(key, *(F.col(c).alias(f"_n_{c}") for c in (*FIGURES, "parse_status", "profit_loss_exempt", "fetched_at")), F.lit(True).alias("_new"))
    joined = stored.join(new, key, "full_outer")
    n = lambda c: F.col(f"_n_{c}")
    status = F.coalesce(n("parse_status"), F.lit(""))
    source = F.col("revenue_source")
    kind = F.lower(F.coalesce(n("filing_format"), F.lit("")))
    guarded = (status == "pdf_no_text_layer") & F.coalesce(n("filing_id") == F.col("filing_id"), F.lit(False)) & F.coalesce(source.isin(*OCR_SOURCES), F.lit(False))
    replacing = n("filing_id").isNotNull() & ~status.isin(*FAILED) & ~guarded
    no_result = reduce(lambda a, b: a & b, (n(c).isNull() for c in ("revenue", "gross_profit", "profit_before_tax", "profit_after_tax")))
    some_size = reduce(lambda a, b: a | b, (n(c).isNotNull() for c in ("employee_count", "net_assets", "total_assets", "net_current_assets")))
    exempt = F.coalesce(n("profit_loss_exempt"), F.lit(False))
    partial = (status == "partial") & no_result & some_size
    partial_exempt, partial_ocr = partial & exempt, partial & ~exempt & (kind == "ocr_pdf")
    replaceable = lambda *more: source.isNull() | source.isin(*FILED_SOURCES, "partial_no_revenue", "pdf_no_text_layer", *more)
    unknown = F.col("revenue").isNull() & source.isNull()
    label = ladder(
        (guarded, source),
        *((n("revenue").isNotNull() & (kind == k), F.lit(f"filed_accounts_{k}")) for k in ("ixbrl", "pdf", "ocr_pdf")),
        (replacing & (status == "pdf_no_text_layer"), F.lit("pdf_no_text_layer")),
        (replacing & partial_exempt, F.lit("partial_no_revenue")),
        (replacing & partial_ocr, F.lit("partial_ocr_no_pl")),
        (replacing, F.lit(None)),
        ((status == "pdf_no_text_layer") & unknown, F.lit("pdf_no_text_layer")),
        (partial_exempt & replaceable(), F.lit("partial_no_revenue")),
        (partial_ocr & replaceable("partial_ocr_no_pl"), F.lit("partial_ocr_no_pl")),
        ((status == "no_filing") & unknown, F.lit("no_recent_filing")),
        (n("filing_id").isNotNull() & (source == "no_recent_filing"), F.lit(None)),
        otherwise=source,
    )
    merged = F.col("_new").isNotNull()

    def value(c: str) -> Column:
        if c in FIGURES:
            return F.when(merged & replacing, n(c)).when(merged & ~guarded, F.coalesce(n(c), F.col(c))).otherwise(F.col(c))
        if c == "revenue_source":
            return F.when(merged, label).otherwise(source)
        if c == "last_enriched_at":
            return F.when(merged, F.coalesce(n("fetched_at"), F.col(c))).otherwise(F.col(c))
        return F.col(c)

    return joined.select(*(value(c).alias(c) for c in stored.columns))


def staged_summary(staged: DataFrame) -> DataFrame:
    """One row of counts over staged filings by state, format and age."""
    status, kind = F.coalesce("parse_status", F.lit("")), F.lower(F.coalesce(F.col("filing_format").cast("string"), F.lit("")))
    counts = {
        "ok_count": status == "ok",
        "partial_count": status.isin("partial", "pdf_parse_partial"),
        "ixbrl_count": kind == "ixbrl",
        "pdf_count": kind.isin("pdf", "ocr_pdf"),
        "pdf_no_text_layer_count": status == "pdf_no_text_layer",
        "no_filing_count": status == "no_filing",
        "stale_count": F.col("filing_age_months") > 24,
        "error_count": status.isin(*FAILED),
    }
    return staged.agg(F.count("*").alias("total_rows"), *(F.count_if(c).alias(k) for k, c in counts.items()))


def banded(df: DataFrame, value: str, bands: DataFrame, columns: list[str], low: str = "min_employees", high: str = "max_employees") -> DataFrame:
    """Columns of the first band that holds a value, both ends included (an open upper end is null); null outside all bands.

    Bands are a reference table of few rows, which goes along with each task; more than MOST_BANDS are refused.
    """
    if len(bands.select(low).limit(MOST_BANDS + 1).collect()) > MOST_BANDS:
        raise ValueError(f"more than {MOST_BANDS} bands")
    b = F.broadcast(bands.select(low, high, *columns))
    inside = (F.col(value) >= F.col(low)) & (F.col(high).isNull() | (F.col(value) <= F.col(high)))
    return df.join(b, inside, "left").drop(low, high)


def estimate_fill(df: DataFrame, bands: DataFrame, label: str = "estimate_employee_band") -> DataFrame:
    """Revenue from the band of the head count where revenue is missing, and where it came from."""
    with_band = banded(df, "employee_count", bands, ["midpoint_gbp"])
    fill = F.col("revenue").isNull() & F.col("midpoint_gbp").isNotNull()
    return with_band.withColumn("revenue_source", F.when(fill, label).otherwise(F.col("revenue_source"))).withColumn("revenue", F.coalesce("revenue", "midpoint_gbp")).drop("midpoint_gbp")


def keep_locked(old: DataFrame, new: DataFrame, keys: list[str], scope: DataFrame, mode: str) -> DataFrame:
    """Persist matches: 'all' replaces what no user has decided inside the scope, 'incremental' adds unseen pairs; a user's decisions stay."""
    if mode not in ("all", "incremental"):
        raise ValueError(f"mode {mode!r}")
    locked = F.col("status").isin("user_confirmed", "user_rejected")
    if mode == "all":
        stay = old.where(locked).unionByName(old.where(~locked).join(scope, keys[0], "left_anti"))
    else:
        stay = old
    return stay.unionByName(new.join(stay.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def progress(batch: DataFrame, seen: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Ledger update in which no counter goes down."""
    right = seen.select(key, *(F.col(c).alias(f"_s_{c}") for c in counters))
    return batch.join(right, key, "left").select(*(F.greatest(F.col(c), F.col(f"_s_{c}")).alias(c) if c in counters else F.col(c) for c in batch.columns))


def fail_stale(batches: DataFrame, as_of, hours: int) -> DataFrame:
    """Running batches without a heartbeat for some hours become failed."""
    old = (F.col("status") == "running") & (F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))
    return batches.withColumn("status", F.when(old, "failed").otherwise(F.col("status")))


def unseen(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return targets.join(done.select(key), key, "left_anti")


def due(targets: DataFrame, done: DataFrame, key: str, time: str, cutoff) -> DataFrame:
    """Targets never done or done before a cutoff."""
    last = done.groupBy(key).agg(F.max(time).alias("_last"))
    return targets.join(last, key, "left").where(F.col("_last").isNull() | (F.col("_last") < cutoff)).drop("_last")
