"""Bringing records of different origin into one shape, and filling gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.labels import canonical_category

# The names a field may arrive under, best first, and its default.
REVIEW_ALIASES = {
    "asin": (["asin", "ASIN", "product_id"], "unknown"),
    "title": (["title", "product_title", "summary"], ""),
    "reviewText": (["reviewText", "review_text", "text"], ""),
    "reviewerName": (["reviewerName", "reviewer_name"], "Anonymous"),
}
NUMBER_ALIASES = {
    "overall": (["overall", "rating", "stars"], "double"),
    "helpfulVotes": (["helpfulVotes", "helpful_votes"], "int"),
    "totalVotes": (["totalVotes", "total_votes"], "int"),
    "confidence": (["confidence", "sentiment_confidence"], "double"),
}
TIME_ALIASES = {
    "date": ["date", "reviewTime", "review_time", "prediction_time"],
    "processedAt": ["processedAt", "processed_at", "prediction_time"],
}


def _present(df: DataFrame, names: list[str]) -> list[str]:
    """Names that are columns of ``df``; spellings the analyzer takes for one column count once."""
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    key = (lambda n: n) if sensitive else str.lower
    have = {key(c) for c in df.columns}
    return list({key(n): n for n in reversed(names) if key(n) in have}.values())[::-1]


def _first_text(df: DataFrame, names: list[str], default: Column) -> Column:
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in _present(df, names)], default)


def _first_number(df: DataFrame, names: list[str], kind: str) -> Column:
    zero = F.lit(0).cast(kind)
    return F.coalesce(*[F.nullif(F.col(n).try_cast(kind), zero) for n in _present(df, names)], zero)


def normalise_review(df: DataFrame, as_of: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One record shape from any alias a field goes by; empty text and zero count as missing.

    A missing time becomes ``as_of`` (default: now). The sentiment is the lower-cased label, or the
    category of the numeric code where there is no label, or empty.
    """
    now = (F.current_timestamp() if as_of is None else as_of).cast("string")
    out = [F.col(c) for c in keep]
    for name, (aliases, default) in REVIEW_ALIASES.items():
        out.append(_first_text(df, aliases, F.lit(default)).alias(name))
    for name, (aliases, kind) in NUMBER_ALIASES.items():
        out.append(_first_number(df, aliases, kind).alias(name))
    for name, aliases in TIME_ALIASES.items():
        out.append(_first_text(df, aliases, now).alias(name))
    label = [F.lower(F.nullif(F.col(c), F.lit(""))) for c in _present(df, ["sentiment_label"])]
    code = [canonical_category(F.col(c)) for c in _present(df, ["sentiment"])]
    out.append(F.coalesce(*label, *code, F.lit("")).alias("sentiment"))
    return df.select(*out)


def fill_missing(df: DataFrame, columns: list[str], value: str = "Missing") -> DataFrame:
    """Null text replaced before training."""
    return df.na.fill(value, columns)


def fill_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null text replaced by the empty string before scoring."""
    return df.na.fill("", columns)


def stamp_processed(df: DataFrame, as_of: Column | None = None, name: str = "processed_at") -> DataFrame:
    """Adds the processing time; ``as_of`` replaces the clock where a run must repeat."""
    return df.withColumn(name, F.current_timestamp() if as_of is None else as_of)
