"""Text cleaning, counting and tokenising."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions.stopwords import STOP_WORDS

# Whitespace and word characters as Unicode defines them, spelled out because the regex engine's
# own \s and \w mean ASCII only. The same classes serve SQL engines without Unicode shorthands.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"

# Steps of clean_text after lower-casing, in order. Possessive quantifiers and the look-behind keep
# each step linear in the text, also on long junk without a match.
SPANS = [
    r"\[[^\n\]]*+\]",  # bracketed spans
    rf"https?://[^{SPACE}]++|www\.[^{SPACE}]++",  # links
    r"<[^\n>]*+>++",  # tags
]
PUNCTUATION = r"[!-/:-@\[-`{-~\n]+"  # ASCII punctuation and line feeds
NUMBER_WORDS = rf"(?<![{WORD}])[{WORD}&&[^\p{{Nd}}]]*+\p{{Nd}}[{WORD}]*+"  # words holding a digit
_SPAN_STARTS = ["[", "http", "www.", "<"]

# What a plain split on whitespace treats as a separator.
_BLANKS = " \t\n\x0b\f\r"


def clean_text(text: Column) -> Column:
    """Lower-cased text without bracketed spans, links, tags, punctuation, line feeds and number words."""
    lowered = F.lower(F.coalesce(text, F.lit("None")))
    without_spans = lowered
    for pattern in SPANS:
        without_spans = F.regexp_replace(without_spans, pattern, "")
    # Plain searches are much cheaper than the replacements, which most texts do not need.
    may_hold_span = reduce(or_, [F.contains(lowered, F.lit(start)) for start in _SPAN_STARTS])
    plain = F.regexp_replace(F.when(may_hold_span, without_spans).otherwise(lowered), PUNCTUATION, "")
    return F.when(plain.rlike(r"\p{Nd}"), F.regexp_replace(plain, NUMBER_WORDS, "")).otherwise(plain)


def review_len(text: Column) -> Column:
    """Length in characters."""
    return F.length(text)


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters."""
    return F.size(F.filter(F.split(text, f"[{SPACE}]++"), lambda word: word != ""))


def concat_review(text: Column, summary: Column) -> Column:
    """Review text and summary, joined without a separator; null if either is null."""
    return F.concat(text, summary)


def tokens(text: Column) -> Column:
    """Lower-cased words split at every single blank, as ``pyspark.ml.feature.Tokenizer`` does.

    Empty tokens between blanks stay, trailing ones go; an empty text is one empty token.
    """
    lowered = F.lower(text)
    kept = F.rtrim(lowered, F.lit(_BLANKS))
    return (
        F.when(lowered == "", F.array(F.lit("")))
        .when(kept == "", F.array().cast("array<string>"))
        .when(kept.isNotNull(), F.split(kept, r"\s"))
    )


def drop_stop_words(words: Column, stop_words: list[str] | None = None) -> Column:
    """Tokens that are not stop words, in order."""
    stops = [w.lower() for w in (STOP_WORDS if stop_words is None else stop_words)]
    return F.filter(words, lambda w: ~F.lower(w).isin(stops))
