"""Filtered, sorted, paged reads."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_list(codes: str | Iterable[str] | None) -> list[str]:
    """Trimmed non-blank codes from a list or a comma-separated text."""
    items = codes.split(",") if isinstance(codes, str) else codes or []
    return [t for t in (str(c).strip() for c in items) if t]


def any_of(columns: list[str], codes) -> Column:
    """Any of several columns holds one of the codes; no codes are an error."""
    wanted = code_list(codes)
    if not wanted:
        raise ValueError("at least one code is needed")
    return reduce(lambda a, b: a | b, (F.col(c).isin(wanted) for c in columns))


def both(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are given."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == value


def starts(column: str, prefix: str | None) -> Column | None:
    return F.col(column).startswith(prefix) if prefix else None


def at_least(column: str, value) -> Column | None:
    return None if value is None else F.col(column) >= value


def at_most(column: str, value) -> Column | None:
    return None if value is None else F.col(column) <= value


def year_range(column: str, first: int | None = None, last: int | None = None) -> Column | None:
    """Whole years as a date range, so that the scan can use it."""
    if first is None and last is None:
        return None
    low = None if first is None else F.col(column) >= F.lit(f"{first:04d}-01-01").cast("date")
    high = None if last is None else F.col(column) < F.lit(f"{last + 1:04d}-01-01").cast("date")
    return both(low, high)


def contains_any_case(columns: list[str], text: str | None) -> Column | None:
    """Any column contains a text, letters' case aside; % and _ in it stay wildcards."""
    if not text:
        return None
    return reduce(lambda a, b: a | b, (F.lower(F.col(c)).like(f"%{text.lower()}%") for c in columns))


def target_search(number: str, names: list[str], text: str | None) -> Column | None:
    """A number contains the text as written, or a name contains it in any case."""
    return (F.col(number).like(f"%{text}%") | contains_any_case(names, text)) if text else None


def any_text(column: str, texts: list[str] | None) -> Column | None:
    return reduce(lambda a, b: a | b, (F.lower(F.col(column)).like(f"%{t.lower()}%") for t in texts)) if texts else None


def list_has_any(column: str, values: list[str] | None) -> Column | None:
    """The list holds one of the values; false, not null, where the list has nulls and none of them."""
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False)) if values else None


def presence(column: str, wanted: bool | None) -> Column | None:
    """True: not null; false: null; None: either."""
    return None if wanted is None else F.col(column).isNotNull() if wanted else F.col(column).isNull()


def any_known(columns: list[str]) -> Column:
    return F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull()


def checked_limit(limit: object) -> int | None:
    """None is unlimited and 0 no rows; booleans, negatives and other types are errors."""
    if limit is None:
        return None
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
        raise ValueError(f"limit must be a whole number of 0 or more, not {limit!r}")
    return limit


def limited(df: DataFrame, limit: object) -> DataFrame:
    n = checked_limit(limit)
    return df if n is None else df.limit(n)


def sort_keys(allowed: dict[str, Column], wanted: str | None, default: str, descending: bool, key: str) -> list[Column]:
    """An allowed sort column (else the default) with nulls last either way, then the primary key, so that pages don't overlap."""
    c = allowed.get(wanted or "", allowed[default])
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key).asc_nulls_last()]


def page(df: DataFrame, keys: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """Rows of a 1-based page."""
    if isinstance(number, bool) or not isinstance(number, int) or number < 1:
        raise ValueError(f"page numbers begin at 1, not {number!r}")
    n = checked_limit(size)
    ordered = df.orderBy(*keys)
    return ordered if n is None else ordered.offset((number - 1) * n).limit(n)


def page_and_total(df: DataFrame, keys: list[Column], number: int = 1, size: int = 50) -> tuple[DataFrame, int]:
    return page(df, keys, number, size), df.count()


def enriched(base: DataFrame, key: str, search: str | None, match: DataFrame, partner: DataFrame, partner_key: str, columns: list[str]) -> DataFrame:
    """The joins that a search text needs are made only if there is one."""
    if not search:
        return base
    joined = base.join(match, key, "left").join(partner, partner_key, "left")
    return joined.where(contains_any_case(columns, search))


def live_columns(df: DataFrame) -> list[str]:
    """Columns with a value in at least one row, from one aggregation."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    return [c for c in df.columns if counts[c]]


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def option_items(df: DataFrame, column: str, separator: str = "|") -> DataFrame:
    """Distinct trimmed items of a separated text in order."""
    items = df.select(F.explode(F.split(column, "\\" + separator)).alias(column)).select(F.trim(column).alias(column))
    return items.where(F.col(column) != "").distinct().orderBy(column)
