"""Parsers for the strings found in review pages."""

from __future__ import annotations

import json
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

_INVISIBLE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def visible_html(html: Column) -> Column:
    """Page source without scripts, styles and comments, whose content is not markup."""
    return F.regexp_replace(html, _INVISIBLE, "")


#: Named references, the frequent ones first.
_NAMES = dict.fromkeys(["amp", "lt", "gt", "quot", "apos", "nbsp", *name2codepoint, *[n[:-1] for n in html5 if n.endswith(";")]])
_NAMED = json.dumps({name: html5[f"{name};"] for name in _NAMES})
#: What pages mean by the numbers of control characters: the letters of a common one-byte encoding.
_MEANT = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}


def _character(number: Column) -> Column:
    """The character with a number; those for control characters by what they mean; null for a number of none."""
    meant = F.get(F.array(*[F.lit(c) for c in _MEANT.values()]), (number - 128).cast("int"))
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(number.between(128, 159), meant).when(valid, char)


def unescape_html(text: Column) -> Column:
    """Character references replaced, each once: named ones and decimal or hex numbers."""
    named = F.from_json(F.lit(_NAMED), "map<string, string>")

    def resolve(piece: Column) -> Column:
        ref = F.regexp_extract(piece, _ENTITY, 1)
        char = (
            F.when(ref.rlike("^#[0-9]"), _character(F.substring(ref, 2, 7).try_cast("bigint")))
            .when(ref.startswith("#"), _character(F.conv(F.substring(ref, 3, 6), 16, 10).try_cast("bigint")))
            .otherwise(F.try_element_at(named, ref))
        )
        rest = F.substr(piece, F.length(ref) + 2)
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    tail = F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), resolve), "")
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(pieces, F.lit(0)), tail)).otherwise(text)


def element_text(html: Column) -> Column:
    """Text of an element: tags dropped, references resolved, blanks trimmed."""
    bare = unescape_html(F.regexp_replace(html, "<[^>]*+>", ""))
    return F.regexp_replace(bare, r"^[\s\x{a0}]++|(?<![\s\x{a0}])[\s\x{a0}]++\z", "")


def _number_in(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]+", "").try_cast("int")


def parse_helpful(text: Column) -> Column:
    """``[helpful, total]`` votes of a vote statement; ``[0, 0]`` without one.

    The "X of Y people" form is tested before "N people", which it contains. A statement with
    no readable number gives null.
    """
    one = F.contains(text, F.lit("One person found this helpful"))
    of_parts = F.split(text, "of", 2)
    is_of = text.rlike(r"(?s)[0-9].*of.*[0-9].*people found this helpful")
    x = _number_in(F.get(of_parts, F.lit(0)))
    y = _number_in(F.substring_index(F.get(of_parts, F.lit(1)), "people", 1))
    n = _number_in(text)
    return (
        F.when(one, F.array(F.lit(1), F.lit(1)))
        .when(is_of, F.when(x.isNotNull() & y.isNotNull(), F.array(x, y)))
        .when(F.contains(text, F.lit("people found this helpful")), F.when(n.isNotNull(), F.array(n, n)))
        .otherwise(F.array(F.lit(0), F.lit(0)))
    )


def parse_rating(text: Column) -> Column:
    """Stars in "4,0 out of 5 stars": the number before "out of"; null if there is none."""
    number = F.replace(F.trim(F.substring_index(text, "out of", 1)), F.lit(","), F.lit("."))
    return number.try_cast("double")


def parse_review_date(text: Column) -> Column:
    """ISO day of "Reviewed in ... on March 5, 2024"; null if there is no such date."""
    day = F.substring_index(text, "on ", -1)
    return F.date_format(F.try_to_timestamp(day, F.lit("MMMM d, yyyy")), "yyyy-MM-dd")


def parse_review_id(element_id: Column) -> Column:
    """Review id in an element id: the text after the last ``customer_review-``."""
    return F.substring_index(element_id, "customer_review-", -1)
