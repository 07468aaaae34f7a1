"""Suspicion rules over filed figures: impossible values, outliers of the logs, outliers of ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import log_mad, suspicion

# Weights, limits, the fields whose logs are compared, and the score's buckets.
STRUCTURAL, FIELD, RATIO, FAR = 10, 2, 4, 3.5
FIELDS = ("revenue", "employee_count", "total_assets", "net_assets", "gross_profit", "profit_before_tax", "profit_after_tax", "net_current_assets")
RATIOS = {"rev_per_emp": ("revenue", "employee_count"), "rev_per_ta": ("revenue", "total_assets")}
SHORTEST, LONGEST = 180, 545  # days of a period
BUCKETS = ((0, "0 (clean)"), (5, "1-4"), (10, "5-9"), (15, "10-14"), (20, "15-19"))


def structural_rules() -> list[tuple[Column, int, str]]:
    """(condition, weight, name) of what can't be; a figure that is missing breaks no rule."""
    c = F.col
    days = F.datediff("filing_period_end", "filing_period_start")
    rules = {
        "ta<na": c("total_assets") < c("net_assets"),
        "ps>=pe": days <= 0,
        "emp<0": c("employee_count") < 0,
        "gp>rev": c("gross_profit") > c("revenue"),
        "pbt>rev": c("profit_before_tax") > c("revenue"),
        "period": (days > 0) & ~days.between(SHORTEST, LONGEST),
        "rev>1B": c("revenue") > 1_000_000_000,
        "rpe_abs>1M": (c("employee_count") > 5) & (c("revenue") > 0) & (c("revenue") / c("employee_count") > 1_000_000),
        "big_rev_few_emp": (c("revenue") > 100_000_000) & (c("employee_count") > 0) & (c("employee_count") < 200),
        "rev>10ta": (c("total_assets") > 0) & (c("revenue") > 10 * c("total_assets")),
    }
    return [(F.coalesce(rule, F.lit(False)), STRUCTURAL, name) for name, rule in rules.items()]


def _far(value: Column, name: str) -> Column:
    """Whether a positive value's log is far from the median, in scaled deviations; never without statistics."""
    return F.coalesce((value > 0) & (F.abs(F.log(value) - F.col(f"_{name}_mid")) / F.col(f"_{name}_mad") > FAR), F.lit(False))


def scored_filings(filings: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """`filings` with suspicion_score, signals ('; ' between) and n_signals: every rule that a row breaks adds its weight.

    The medians and deviations are over all rows; they are one row of statistics for all columns, which goes along with each task.
    """
    both = lambda n, d: F.when((F.col(n) > 0) & (F.col(d) > 0), F.col(n) / F.col(d))
    rows = filings.withColumns({f"_{name}": both(n, d) for name, (n, d) in RATIOS.items()})
    measured = {f: F.col(f) for f in fields} | {name: F.col(f"_{name}") for name in RATIOS}
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c.cast("double").alias("value")) for n, c in measured.items()))).alias("m")).select("m.*")
    facts = log_mad(long, ["field"], "value")
    wide = facts.agg(*(F.max(F.when(F.col("field") == n, F.col(stat))).alias(f"_{n}_{short}") for n in measured for stat, short in (("median_log", "mid"), ("mad_log", "mad"))))
    rules = structural_rules() + [(_far(F.col(f), f), FIELD, f"{f}_z") for f in fields] + [(_far(F.col(f"_{n}"), n), RATIO, f"{n}_z") for n in RATIOS]
    score, signals, _ = suspicion(rules)
    out = rows.join(F.broadcast(wide))  # one row of statistics
    return out.select(*filings.columns, score.alias("suspicion_score"), F.array_join(signals, ";").alias("signals"), F.size(signals).alias("n_signals"))


def score_bucket(score) -> Column:
    """Bucket of a suspicion score."""
    out = None
    for least, name in BUCKETS:
        test = F.col(score) == 0 if least == 0 else F.col(score) < least
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("20+")
