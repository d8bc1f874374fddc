"""Sentiment classes, labels, categories and percentages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.schema import CATEGORIES, CLASS_LABELS, NEGATIVE, NEUTRAL, POSITIVE


def label_from_rating(rating: Column, strict: bool = False) -> Column:
    """Class of a star rating: 3 is neutral, 1 and 2 are negative, anything else is positive.

    A missing rating counts as positive too; ``strict`` leaves it without a class instead.
    """
    label = F.when(rating == 3.0, NEUTRAL).when(rating.isin(1.0, 2.0), NEGATIVE).otherwise(POSITIVE)
    return F.when(rating.isNotNull(), label) if strict else label


def sentiment_label(code: Column, strict: bool = False) -> Column:
    """Label of a class code. Codes other than 0 and 1 read Positive; ``strict`` gives them null."""
    label = F.when(code == NEGATIVE, CLASS_LABELS[NEGATIVE]).when(code == NEUTRAL, CLASS_LABELS[NEUTRAL])
    if strict:
        return label.when(code == POSITIVE, CLASS_LABELS[POSITIVE])
    return label.otherwise(CLASS_LABELS[POSITIVE])


def has_sentiment(wanted: int, code: Column, label: Column) -> Column:
    """True where the code equals the class or the label spells it, in any case."""
    return F.coalesce(code == wanted, F.lit(False)) | F.coalesce(
        F.lower(label) == CATEGORIES[wanted], F.lit(False)
    )


def canonical_category(
    sentiment: Column, label: Column | None = None, unknown: str = "drop", numeric: bool = False
) -> Column:
    """``positive``, ``neutral`` or ``negative`` from a code, a category text, or a label.

    ``unknown="drop"`` gives null for anything else, so that the caller can filter it out;
    ``unknown="neutral"`` counts it as neutral. ``numeric`` says the sentiment is a number, which
    spares turning it into text.
    """
    if unknown not in ("drop", "neutral"):
        raise ValueError(f"unknown must be 'drop' or 'neutral', not {unknown!r}")
    text = None if numeric else F.lower(sentiment.cast("string"))
    category = None
    for code, name in CATEGORIES.items():
        spelled = sentiment == code if numeric else text.isin(str(code), f"{code}.0", name)
        if label is not None:
            spelled = spelled | (F.lower(label) == name)
        category = F.when(spelled, name) if category is None else category.when(spelled, name)
    return category.otherwise("neutral") if unknown == "neutral" else category


def category_of(df: DataFrame, sentiment: str = "sentiment", label: str | None = "sentiment_label") -> Column:
    """``canonical_category`` of the columns of ``df``, by the type the sentiment has there."""
    numeric = isinstance(df.schema[sentiment].dataType, T.NumericType)
    return canonical_category(F.col(sentiment), F.col(label) if label else None, numeric=numeric)


def integer_percent(part: Column, total: Column) -> Column:
    """Share of ``part`` in ``total`` as a whole percentage, half up; 0 where there is no total."""
    share = F.round(F.try_divide(part, total) * 100)
    return F.when(total > 0, share).otherwise(0.0).cast("bigint")
