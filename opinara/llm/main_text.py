"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped to one line per block element. The text lengths of neighbouring lines are summed
over a sliding window; where the sum surges the main text begins, where it dives it ends. Elements that seldom hold
main text (menus, forms, adverts) are weighed against the rest of the page: unless by far the most of its text stands in one, it goes,
and leaves empty lines behind, in which every window dives. Where the page
marks its article, any line in it is a surge, and lines outside are a run of their own; a mark that holds less text
than surges outside it (cards of other stories) has no weight.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import without

#: Lines in a window, and the sum from which a window counts as a surge outside a marked article.
WINDOW, SURGE = 3, 100
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Elements without main text, those that seldom hold it, and those whose content is no markup.
DROPPED = frozenset(
    "head title menu dialog button select option textarea input label iframe object embed applet svg canvas video audio map noscript "
    "noframes template math".split()
)
SELDOM = {"nav": "never", "aside": "never", "footer": "never", "form": "soft", "fieldset": "soft", "header": "soft"}
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark what is about the page or beside it, those that also mark what is around the article, and those that mark the article.
NEVER = frozenset(
    "ad ads adv alert advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist contentinfo cookie "
    "cookies consent copyright disclaimer discussion disqus footer gdpr login menu menubar nav navbar navigation newsletter notice notices "
    "notification outbrain pager pagination popup promo promoted promotion recommended recommendation recommendations related replies reply "
    "respond search share sharing signup skip social sponsor sponsored subscribe subscription taboola tagcloud teaser teasers toast".split()
)
SOFT = frozenset("banner complementary dialog dropdown form header hidden masthead modal overlay paywall sidebar sitemap toolbar widget widgets".split())
#: Words that, in front of a mark in a name, say that it is not the mark's own element.
NOT_ITS_OWN = frozenset("has no not is with without hide show".split())
#: The rest of the page need not have more than this share of an element's text for the element to hold the article.
REST = 1 / 3
ARTICLE = frozenset("article articlebody main maincontent postbody storybody entrycontent postcontent articlecontent".split())
LONG_ARTICLE = tuple(x for x in sorted(ARTICLE) if len(x) > 7)
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|itemprop|hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _class_kind(value: str, in_article: bool) -> str:
    """What the names in a class, id or role say: ``article``, ``never``, ``soft`` or nothing."""
    found = ""
    for name in value.split():
        whole = name.replace("-", "").replace("_", "")
        if whole in ARTICLE or whole.endswith(LONG_ARTICLE):
            return "article"
        parts = re.split(r"[_-]+", name)
        if parts[0] in NOT_ITS_OWN:
            continue
        if not NEVER.isdisjoint(parts):
            found = "never"
        elif not found and not SOFT.isdisjoint(parts) and not (in_article and "header" in parts and SOFT.isdisjoint({*parts} - {"header"})):
            found = "soft"
    return found


def kind_of(tag: str, attributes: str, in_article: bool) -> str:
    """``drop``, ``never``, ``soft``, ``article`` or empty, by an element's name and attributes."""
    if tag in DROPPED:
        return "drop"
    found = "article" if tag in ("article", "main") else SELDOM.get(tag, "") if tag != "header" or not in_article else ""
    if not attributes.strip():
        return found
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "drop"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "drop"
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            said = _class_kind(value, in_article)
            if said == "article" or (said and found != "article" and (not found or said == "never")):
                found = said
        if name in ("class", "id") and tag == "article" and {"comment", "reply", "teaser", "ad"} & set(re.split(r"[\s_-]+", value)):
            return "never"
        if name == "itemprop" and value == "articlebody":
            found = "article"
    return found


class Mark:
    """A marked element: its kind, the mark it is in, whether it was closed, what it holds, and what is decided."""

    def __init__(self, kind: str, parent: Mark | None, footer: bool):
        self.kind, self.parent, self.footer = kind, parent, footer
        self.closed = self.article = self.heading = self.kept = False
        self.own = self.plain = self.linked = 0

    def decide(self, outside: int) -> None:
        """Keeps the element if it must hold the article: by far the most of the page's text stands in it."""
        if self.parent is not None and not self.parent.kept:
            return
        enough = self.plain >= SURGE and self.plain >= self.linked
        if self.kind == "never" and (self.closed or self.footer):
            self.kept = enough and outside < SURGE and (self.article or self.heading)
        elif self.article or not self.closed:
            self.kept = enough and self.plain * 3 >= outside
        else:
            self.kept = enough and outside < REST * self.plain


Line = tuple[str, int, bool]


def _settled(lines: list[tuple[str, int, bool, Mark | None, bool]], marks: list[Mark]) -> list[Line]:
    """The lines outside dropped elements; each of those leaves empty ones behind."""
    outside = 0
    for text, linked, _, mark, _ in lines:
        plain = max(len(text) - linked, 0)
        if mark is None:
            outside += plain
        else:
            mark.own += plain
        while mark is not None:
            mark.plain += plain
            mark.linked += len(text) - plain
            mark = mark.parent
    # Larger ones first, so that what is beside the article is held against it; no element is larger than the one it is in.
    for mark in sorted(marks, key=lambda m: -m.plain):
        mark.decide(outside)
        if mark.kept:
            outside += mark.own
    return [(text, linked, inside) for text, linked, inside, mark, parting in lines if mark is None or mark.kept != parting]


def lines_of(page: str) -> list[Line]:
    """Each block's text, the length of it that is in links, and whether it is in an article; empty ones for what is dropped, with length 1 for a footer."""
    lines: list[tuple[str, int, bool, Mark | None, bool]] = []
    marks: list[Mark] = []
    parts: list[str] = []
    linked = 0
    open_tags: list[tuple[str, str, Mark | None]] = []
    dropping, articles, links = 0, 0, 0
    mark: Mark | None = None

    def end_line() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            lines.append((text, min(linked, len(text)), articles > 0, mark, False))
        parts.clear()
        linked = 0

    def close(down_to: int, named: bool = False) -> None:
        """Closes elements; the last of them by its own tag if ``named``."""
        nonlocal dropping, articles, mark
        while len(open_tags) > down_to:
            _, kind, own = open_tags.pop()
            dropping -= kind == "drop"
            articles -= kind == "article"
            if kind == "drop" and not dropping:
                lines.extend([("", 0, articles > 0, mark, False)] * WINDOW)
            if own is not None:
                own.closed = named and len(open_tags) == down_to
                lines.extend([("", int(own.footer), articles > 0, own, True)] * WINDOW)
                mark = own.parent

    at = 0
    for piece in _PIECE.finditer(page):
        if not dropping and piece.start() > at:
            chunk = page[at : piece.start()]
            parts.append(chunk)
            linked += len(chunk) if links else 0
        at = piece.end()
        tag = (piece[3] or "").lower()
        if not tag:
            continue
        if tag == "a":
            links = 0 if piece[2] else 1
        if tag == "br" and not dropping:
            parts.append(" ")
        kind = "" if piece[2] else kind_of(tag, piece[4], articles > 0)
        if tag not in BLOCKS and not kind and all(t != tag for t, _, _ in open_tags):
            continue
        if not dropping and (tag in BLOCKS or kind in ("drop", "never", "soft")):
            end_line()
        if tag in VOID:
            continue
        if not piece[2]:
            if tag in BLOCKS and open_tags and open_tags[-1][0] == "p":
                close(len(open_tags) - 1)
            if mark is not None and not dropping:
                inside: Mark | None = mark
                while inside is not None and (kind == "article" or tag == "h1"):
                    inside.article |= kind == "article"
                    inside.heading |= tag == "h1"
                    inside = inside.parent
            if not kind and (tag == "p" or not (tag in ("div", "section", "article", "main") or dropping)):
                continue
            if tag == "body":
                close(0)
            if piece[4].rstrip().endswith("/") and kind == "drop" and tag in ("svg", "object", "math"):
                continue
            own = None
            if kind in ("never", "soft") and not dropping:
                footer = tag == "footer" or re.search(r"\b(?:footer|contentinfo)\b", piece[4], re.I) is not None
                own = mark = Mark(kind, mark, footer)
                marks.append(own)
            open_tags.append((tag, kind, own))
            dropping += kind == "drop"
            articles += kind == "article"
        else:
            place = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == tag), None)
            if place is not None:
                close(place, named=True)
    if not dropping:
        parts.append(page[at:])
    end_line()
    close(0)
    return _settled(lines, marks)


def spans(lengths: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Runs of lines from a surge to the next dive.

    A window sums a line and those after it. It surges where it reaches ``surge``, and the run goes back over the
    lines before it to the previous dive; it dives where it is zero. A run begins and ends with a line that has a length.
    """
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    found, i = [], 0
    while i < len(lengths):
        if not sums[i]:
            i += 1
            continue
        start = i
        while i < len(lengths) and sums[i]:
            i += 1
        if max(sums[start:i]) >= surge:
            has = [k for k in range(start, i) if lengths[k]]
            found.append((has[0], has[-1] + 1))
    return found


def kept_spans(lines: list[tuple[str, int, bool]], lengths: list[int]) -> list[tuple[int, int]]:
    """Runs that surge, and shorter ones after them that no footer parts from them."""
    surging, kept = set(spans(lengths, SURGE)), []
    last = max((s for s, _ in surging), default=-1)
    for start, end in spans(lengths, 1):
        after = kept and (start < last or not any(not text and ended for text, ended, _ in lines[kept[-1][1] : start]))
        if (start, end) in surging or after:
            kept.append((start, end))
    return kept


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by line breaks; empty if there is none."""
    lines = lines_of(page or "")
    lengths = [max(len(text) - linked, 0) for text, linked, _ in lines]
    marked = [len(text) if inside else 0 for text, _, inside in lines]
    rest = [0 if inside else n for n, (_, _, inside) in zip(lengths, lines)]
    outside = spans(rest, SURGE)
    if any(marked) and sum(sum(rest[slice(*s)]) for s in outside) <= sum(marked):
        places = {i for s in spans(marked, 1) for i in range(*s) if marked[i]} | {i for s in outside for i in range(*s) if not lines[i][2]}
    else:
        kept = kept_spans(lines, lengths) or [s for s in [max(spans(lengths, 1), key=lambda s: sum(lengths[slice(*s)]), default=None)] if s]
        places = {i for s in kept for i in range(*s)}
    return "\n".join(lines[i][0] for i in sorted(places) if lines[i][0])


def _extract_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(main_text, na_action=None)


def extract_main_text(df: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """Replaces the page column by its main text and the text's length in code points, ``n_chars``.

    A null, empty or text-free page gives an empty text; a page cut off in the middle is read to its
    end. Columns named like the new ones are replaced. Repeated rows each get their text. One pass
    per page, no shuffle.
    """
    rest = without(df, html, to, "n_chars").columns
    texts = F.pandas_udf(_extract_batches, "string")(F.col(f"`{html}`"))
    extracted = df.select(*[F.col(f"`{c}`") for c in rest], texts.alias(to))
    return extracted.withColumn("n_chars", F.length(to).cast("long"))
