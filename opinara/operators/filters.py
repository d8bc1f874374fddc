"""Predicates of the dashboard. Each is a plain Column, so the optimizer can push it to the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.labels import has_sentiment
from opinara.schema import CATEGORIES

# Names of the time ranges and their length in days.
TIME_RANGE_DAYS = {
    "last-24h": 1,
    "last-24-hours": 1,
    "24h": 1,
    "last-7-days": 7,
    "last-7d": 7,
    "7d": 7,
    "last-30-days": 30,
    "last-30d": 30,
    "30d": 30,
    "last-90-days": 90,
    "last-90d": 90,
    "90d": 90,
}
_CODES = {name: code for code, name in CATEGORIES.items()}


def latest_time(df: DataFrame, ts: str = "review_ts") -> Column:
    """The newest event time as a scalar subquery, for use as ``as_of``."""
    return df.agg(F.max(ts)).scalar()


def text_present(column: str = "review_text") -> Column:
    return F.col(column).isNotNull()


def range_start(time_range: str | None, as_of: Column) -> Column | None:
    """When a named range before ``as_of`` begins; null for other names."""
    days = TIME_RANGE_DAYS.get(time_range)
    return None if days is None else as_of - F.expr(f"INTERVAL '{days}' DAY")


def in_time_range(time_range: str | None, as_of: Column, ts_columns: tuple[str, ...] = ("review_ts",)) -> Column | None:
    """At or after the start of a named range in any of the time columns; no predicate for other names."""
    start = range_start(time_range, as_of)
    return None if start is None else reduce(or_, [F.col(c) >= start for c in ts_columns])


def in_sentiment(category: str, code: str = "sentiment", label: str = "sentiment_label") -> Column:
    return has_sentiment(_CODES[category.lower()], F.col(code), F.col(label))


def at_least_stars(stars: float = 5.0, column: str = "overall") -> Column:
    return F.col(column) >= stars


def contains_text(term: str, *columns: str) -> Column:
    """Any of the columns holds the term, in any case; no character of the term is a wildcard."""
    needle = F.lower(F.lit(term))
    return reduce(or_, [F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False)) for c in columns])


def search_reviews(df: DataFrame, term: str, columns: tuple[str, ...] = ("review_text", "reviewer_name")) -> DataFrame:
    """Reviews whose text or reviewer holds the term; an empty term keeps all."""
    return df.where(contains_text(term, *columns)) if term else df


def asin_contains(part: str | None) -> Column:
    """Product id holds the part, in any case; rows without an id never do."""
    present = F.col("asin").isNotNull() & (F.col("asin") != "")
    return present & contains_text(part, "asin") if part else present


def dashboard_filter(
    df: DataFrame,
    product: str | None = None,
    reviewer: str | None = None,
    time_range: str | None = None,
    sentiment: str | None = None,
    as_of: Column | None = None,
    ts_columns: tuple[str, ...] = ("review_ts",),
) -> DataFrame:
    """All given conditions together; ``None`` and ``"all"`` put no condition."""
    now = F.current_timestamp() if as_of is None else as_of
    conditions = [
        F.col("asin") == product if product not in (None, "all") else None,
        F.col("reviewer_id") == reviewer if reviewer not in (None, "all") else None,
        in_time_range(time_range, now, ts_columns),
        in_sentiment(sentiment) if sentiment not in (None, "all") else None,
    ]
    given = [c for c in conditions if c is not None]
    return df.where(reduce(and_, given)) if given else df


def quick_filter(df: DataFrame, name: str, as_of: Column) -> DataFrame:
    """The one-click filters: ``all``, ``5-stars``, ``recent`` (7 days) or a sentiment category."""
    if name == "all":
        return df
    if name == "5-stars":
        return df.where(at_least_stars())
    if name == "recent":
        return df.where(in_time_range("7d", as_of))
    return df.where(in_sentiment(name))
