"""Elements of page source, found by counting the depth of tags.

A page becomes a list of pieces, each a tag with the text after it. A running sum over the opening and closing
tags of one name gives each of them its depth, and an element ends where the depth falls below its own: so elements within
it stay whole, whatever other tags are left open.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions.parsing import unescape_html

_TAG = r"</?[a-zA-Z](?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>"
#: Pattern of the tag a piece begins with.
OPENING = f"^{_TAG}"
_PIECE = _TAG + r"(?:[^<]++|<(?!/?[a-zA-Z]))*+"
#: Steps of a running sum that are added up together.
_CHUNK = 64


@dataclass(frozen=True)
class Element:
    """Elements of a name with an attribute, which is the value, begins with it, or has it as one of its words; inside others or anywhere."""

    name: str
    attribute: str | None = None
    value: str = ""
    how: str = "is"
    within: Element | None = None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces_of(html: Column) -> Column:
    """Each tag with the text after it; what stands before the first tag is in no element."""
    return F.regexp_extract_all(html, F.lit(_PIECE), F.lit(0))


def _raw_attribute(tag: Column, name: str) -> Column:
    """An attribute's value as written, without its quotes; empty without it. Quoted values before it are passed over whole."""
    before = r"^<[a-z][^\s/>]*(?:[^'\">]|\"[^\"]*+\"|'[^']*+')*?"
    value = F.regexp_extract(tag, rf"(?i){before}\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.regexp_replace(value, r"^[\"']|[\"']$", "")


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, references resolved; empty without it. The tag may be followed by text."""
    return let(_raw_attribute(tag, name), unescape_html)


def running_sum(steps: Column) -> Column:
    """Sums of a list's numbers up to each of them; chunks are summed apart, so that long lists stay cheap."""
    zero = F.array(F.lit(0))
    sums = lambda numbers, start: F.aggregate(numbers, start, lambda s, x: F.concat(s, F.array(F.get(s, F.size(s) - 1) + x)))

    def summed(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x))
        return let(sums(totals, zero), lambda before: F.flatten(F.transform(chunks, lambda c, i: F.slice(sums(c, F.array(F.get(before, i))), F.lit(2), F.size(c)))))

    parts = lambda all_steps: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / _CHUNK).cast("int")), lambda i: F.slice(all_steps, i * _CHUNK + 1, F.lit(_CHUNK)))
    return let(steps, lambda all_steps: F.when(F.size(all_steps) > 0, let(parts(all_steps), summed)).otherwise(F.array().cast("array<int>")))


def _matches(piece: Column, element: Element) -> Column:
    opens = piece.rlike(rf"(?i)^<{element.name}[\s/>]")
    if element.attribute is None:
        return opens
    value = _raw_attribute(piece, element.attribute)
    fits = {
        "is": lambda: value == element.value,
        "begins": lambda: F.startswith(value, F.lit(element.value)),
        "word": lambda: F.array_contains(F.split(value, r"\s+"), element.value),
    }[element.how]()
    return opens & F.contains(piece, F.lit(element.value)) & fits


def elements(pieces: Column, element: Element) -> Column:
    """The pieces of each such element in order, from its opening tag up to its closing one, which is left out.

    An element that is not closed ends where the next such element begins, or with the pieces. Elements of this
    kind inside others of it are given, too.
    """
    if element.within is not None:
        inner = Element(element.name, element.attribute, element.value, element.how)
        return F.flatten(F.transform(elements(pieces, element.within), lambda e: elements(e, inner)))

    def found(all_pieces: Column) -> Column:
        step = lambda p: F.when(p.rlike(rf"(?i)^<{element.name}[\s/>]"), 1).when(p.rlike(rf"(?i)^</{element.name}[\s/>]"), -1).otherwise(0)
        starts = F.filter(F.transform(all_pieces, lambda p, i: F.when(_matches(p, element), i)), lambda i: i.isNotNull())
        n = F.size(all_pieces)

        def cut(depth: Column, begins: Column) -> Column:
            def one(i: Column, k: Column) -> Column:
                closed = F.array_position(F.slice(depth, i + 2, n), F.get(depth, i) - 1).cast("int")
                return F.slice(all_pieces, i + 1, F.when(closed > 0, closed).otherwise(F.coalesce(F.get(begins, k + 1), n) - i))

            return F.transform(begins, one)

        nothing = F.array().cast("array<array<string>>")
        return let(starts, lambda begins: F.when(F.size(begins) > 0, let(running_sum(F.transform(all_pieces, step)), lambda depth: cut(depth, begins))).otherwise(nothing))

    return let(pieces, found)


def first_element(pieces: Column, element: Element) -> Column:
    """The first such element's pieces; null without one."""
    return F.get(elements(pieces, element), F.lit(0))


def last_element(pieces: Column, element: Element) -> Column:
    """The last such element's pieces; null without one."""
    return let(elements(pieces, element), lambda all_of: F.get(all_of, F.size(all_of) - 1))


def source_of(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def text_of(pieces: Column) -> Column:
    """Text of an element, whatever elements are in it: references resolved, blanks trimmed; null for null."""
    source = F.array_join(F.transform(pieces, lambda p: F.regexp_replace(p, OPENING, "")), "")
    return F.regexp_replace(let(source, unescape_html), r"^[\s\x{a0}]++|(?<![\s\x{a0}])[\s\x{a0}]++\z", "")
