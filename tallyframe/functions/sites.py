"""Web addresses: hosts, roots, scores and picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import col, words_of
from .scores import ladder

#: Words of a company name that say nothing about its site.
NAME_STOP_WORDS = ("ltd", "limited", "the", "uk", "care", "services")
MIN_SCORE = 4


def domain_of(url) -> Column:
    """Lower-case host with port, without a leading 'www.'."""
    return F.regexp_replace(F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def is_root(url) -> Column:
    """No path but '/', and no query."""
    return col(url).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?(#.*)?$")


def root_url(url) -> Column:
    return F.regexp_replace(col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)[\s\S]*$", "$1/")


def on_list(domain, listed: list[str]) -> Column:
    """The domain or one that it lies under is listed."""
    d = col(domain)
    return reduce(lambda a, b: a | b, ((d == x) | d.endswith("." + x) for x in listed), F.lit(False))


def name_tokens(name) -> Column:
    """Distinct words of a name of three letters or more, without stop words."""
    stop = F.array(*map(F.lit, NAME_STOP_WORDS))
    cleaned = F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), "[^a-z0-9 ]", "")
    return F.array_distinct(F.filter(words_of(cleaned), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def site_score(url, tokens) -> Column:
    """3 for a UK address or 1 for .com, 2 for a root, 4 for each name word in the host without hyphens."""
    domain = domain_of(url)
    bare = F.regexp_replace(domain, "-", "")
    place = ladder((domain.endswith(".uk"), 3), (domain.endswith(".com"), 1), otherwise=0)
    return place + F.when(is_root(url), 2).otherwise(0) + 4 * F.size(F.filter(col(tokens), lambda w: bare.contains(w)))


def pick_reason(url, tokens) -> Column:
    """Why a picked site was taken, the strongest reason first."""
    domain = domain_of(url)
    bare = F.regexp_replace(domain, "-", "")
    return ladder(
        (col(url).isNull(), "no_match_above_threshold"),
        (domain.endswith(".uk"), "top_scored_with_uk_tld"),
        (F.exists(col(tokens), lambda w: bare.contains(w)), "top_scored_name_overlap"),
        (is_root(url), "top_scored_root_url"),
        (domain.endswith(".com"), "top_scored_with_com_tld"),
        otherwise="top_scored_above_threshold",
    )
