"""Scoring ladders and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import col

#: The canonical verdicts and the spellings that stand for them.
VERDICTS = {
    "majority domiciliary care": "Majority domiciliary",
    "majority domiciliary": "Majority domiciliary",
    "majority supported living": "Majority Supported living",
    "majority residential": "Majority residential",
    "mixed_domiciliary_supported": "Mixed_domiciliary_supported",
    "mixed residential domiciliary": "Mixed_residential_domiciliary",
    "mixed_residential_domiciliary": "Mixed_residential_domiciliary",
    "unable to classify": "Unable to classify",
}


def ladder(*steps: tuple[Column, object], otherwise: object = None) -> Column:
    """First step whose condition holds."""
    out = F.when(*steps[0])
    for condition, value in steps[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def canonical_verdict(c) -> Column:
    """Known spellings to their canonical form, unknown ones kept, blank and null to 'Unable to classify'."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    known = F.create_map(*(F.lit(x) for pair in VERDICTS.items() for x in pair))
    return F.when(t == "", "Unable to classify").otherwise(F.coalesce(known[F.lower(t)], t))


def class_points(verdict) -> Column:
    """Points 0 to 3 of a verdict text; a common misspelling of 'domiciliary' counts as it."""
    v = F.lower(F.trim(F.coalesce(col(verdict), F.lit(""))))
    home = v.contains("domiciliary") | v.contains("domicilairy")
    housed, resident = v.contains("supported"), v.contains("residential")
    mostly = v.contains("majority") | (v.startswith("likely") & (F.length(v) >= 7)) | v.startswith("primarily ") | v.startswith("predominantly ")
    main = ladder((resident & ~home, 0), (housed & ~resident & ~home, 1), (home, 3), otherwise=0)
    return ladder(
        ((v == "") | v.startswith("unable to classify"), 0),
        (v.contains("mixed") & home & housed, 2),
        (v.contains("mixed") & home & resident, 1),
        (mostly, main),
        (home & ~resident & ~housed, 3),
        (housed & ~home & ~resident, 1),
        otherwise=0,
    )


def age_points(average, over_60, all_over_60) -> Column:
    return ladder((F.coalesce(col(all_over_60), F.lit(False)), 3), ((col(over_60) >= 1) & (col(average) >= 55), 2), (col(average) >= 50, 1), otherwise=0)


def size_points(revenue) -> Column:
    """Bands of revenue; just under five million lies between two bands and scores 0."""
    r = col(revenue)
    return ladder((r.between(5e6, 25e6), 2), (r.between(1e6, 4999999.999999), 1), ((r > 25e6) & (r <= 50e6), 1), otherwise=0)


def service_points(at_home, housed, resident) -> Column:
    h, s, r = col(at_home), col(housed), col(resident)
    return ladder((h & ~s & ~r, 3), (h & s & ~r, 2), (h & r, 1), (~h & s & ~r, 1), otherwise=0)


def tier(total, class_pts) -> Column:
    t, c = col(total), col(class_pts)
    return ladder(((c == 0) | (t == 0), "Excluded"), (t >= 6, "Tier 1"), (t >= 4, "Tier 2"), otherwise="Tier 3")


def agreement(sources, distinct) -> Column:
    """Whether several sources say the same."""
    return ladder(((col(sources) >= 2) & (col(distinct) == 1), "agree"), ((col(sources) >= 2) & (col(distinct) > 1), "disagree"), otherwise="single_source")


def missing_names(required: dict[str, str | Column]) -> Column:
    """Comma-joined names of what is null, in order; '' if nothing is."""
    return F.array_join(F.array_compact(F.array(*(F.when(col(c).isNull(), F.lit(n)) for n, c in required.items()))), ",")


def parse_status(required: dict[str, str | Column], failed: Column | None = None) -> Column:
    """'ok' with all there, 'partial' with some, 'error' with none or after a failure."""
    got = reduce(lambda a, b: a + b, (col(c).isNotNull().cast("int") for c in required.values()))
    none = got == 0
    return ladder((none if failed is None else failed | none, "error"), (got == len(required), "ok"), otherwise="partial")


def filed_only(value, source, estimated: tuple[str, ...] = ("estimate_employee_band",)) -> Column:
    """A figure unless its source says that it is an estimate."""
    return F.when(~F.coalesce(col(source), F.lit("")).isin(*estimated), col(value))


def prime_target(oldest_director, years_trading, employees, least_age: int = 58, least_years: float = 5, least_employees: int = 20) -> Column:
    """All three known and past their limits."""
    return F.coalesce((col(oldest_director) >= least_age) & (col(years_trading) > least_years) & (col(employees) > least_employees), F.lit(False))


def notes(*steps: tuple[Column, str]) -> Column:
    """All notes whose condition holds, '; ' between."""
    return F.concat_ws("; ", *(F.when(c, F.lit(t)) for c, t in steps))
