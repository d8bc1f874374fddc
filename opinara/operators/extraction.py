"""From raw pages to review records.

Generators are outer with a test of their rows behind them: a plain one makes the optimizer test the
list first, and build it twice.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.markup import OPENING, Element, attribute, elements, first_element, last_element, let, pieces_of, source_of, text_of
from opinara.functions.parsing import (
    parse_helpful,
    parse_rating,
    parse_review_date,
    parse_review_id,
    unescape_html,
    visible_html,
)


@dataclass(frozen=True)
class Selector:
    """A repeated block by patterns: that of its opening tag, and of what ends it before the next one opens."""

    opening: str
    closing: str | None = None


# Where reviews sit on a product page, best first.
_BY_ID = Element("div", "id", "customer_review-", "begins")
REVIEW_SELECTORS = [
    Element("div", "data-hook", "review"),
    _BY_ID,
    replace(_BY_ID, within=Element("span", "data-hook", "cr-widget-FocalReviews")),
]
#: Fixed value: the class of a product's card on a list of products.
CARD = "p13n-sc-uncoverable-faceout"
_HREF = r"""(?i)<a\b(?:[^'">]|"[^"]*+"|'[^']*+')*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def absolute(href: Column, url: Column) -> Column:
    """A link's target as a full address, from the address of its page."""
    host = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    folder = F.concat(host, F.coalesce(F.nullif(F.regexp_extract(url, r"^https?://[^/?#]+(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/")))
    return (
        F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(url, "^https?:", 0), href))
        .when(F.startswith(href, F.lit("/")), F.concat(host, href))
        .otherwise(F.concat(folder, href))
    )


def extract_links(pages: DataFrame, marker: str = "/dp/", url: str = "url", html: str = "html", card: str | None = None) -> DataFrame:
    """Links whose target holds ``marker``: position, absolute address, and id, the segment after it.

    With ``card``, a class, only the first such link in each ``div`` of that class counts, and the position is the card's.
    """
    visible = visible_html(F.col(html))
    targets = lambda source: F.filter(F.regexp_extract_all(source, F.lit(_HREF), 1), lambda h: F.contains(h, F.lit(marker)))
    if card:
        cards = elements(pieces_of(visible), Element("div", "class", card, "word"))
        hrefs = F.transform(cards, lambda c: F.get(targets(source_of(c)), F.lit(0)))
    else:
        hrefs = F.regexp_extract_all(visible, F.lit(_HREF), 1)
    quoted = F.col("href")
    href = unescape_html(F.regexp_replace(quoted, r"^[\"']|[\"']$", ""))
    found = pages.select(
        *[c for c in pages.columns if c != html], F.posexplode_outer(hrefs).alias("pos", "href")
    ).where(F.contains(quoted, F.lit(marker)))
    return found.select(
        *[c for c in pages.columns if c != html],
        "pos",
        absolute(href, F.col(url)).alias("link"),
        F.substring_index(F.substr(href, F.instr(href, marker) + F.lit(len(marker))), "/", 1).alias("id"),
    )


def _blocks_of(html: Column, selector: Selector) -> Column:
    """Stretches from one opening tag to the next, each with its own opening tag, cut at the closing."""
    openings = F.regexp_extract_all(html, F.lit(selector.opening), F.lit(0))
    parts = F.split(html, selector.opening)
    bodies = F.slice(parts, F.lit(2), F.size(parts))
    if selector.closing:
        bodies = F.transform(bodies, lambda b: F.get(F.split(b, selector.closing, 2), F.lit(0)))
    return F.zip_with(openings, bodies, lambda o, b: F.struct(o.alias("opening"), b.alias("body")))


def _elements_of(pieces: Column, element: Element) -> Column:
    """Elements as their opening tag and the source in them."""

    def block(e: Column) -> Column:
        source = source_of(e)
        opening = F.regexp_extract(F.get(e, F.lit(0)), OPENING, 0)
        return F.struct(opening.alias("opening"), F.substr(source, F.length(opening) + 1).alias("body"))

    return F.transform(elements(pieces, element), block)


def extract_blocks(pages: DataFrame, selectors: list[Selector | Element], html: str = "html") -> DataFrame:
    """Repeated blocks of a page by the first selector that finds any: its number, position, tag, content.

    An ``Element`` gives whole elements, each up to its own closing tag; a ``Selector`` what its patterns cut out.
    """
    visible = pages.withColumn(html, visible_html(F.col(html)))

    def choice(i: int, s: Selector | Element, pieces: Column) -> Column:
        if isinstance(s, Selector):
            return F.when(F.col(html).rlike(s.opening), F.struct(F.lit(i).alias("selector"), _blocks_of(F.col(html), s).alias("blocks")))
        return let(_elements_of(pieces, s), lambda found: F.when(F.size(found) > 0, F.struct(F.lit(i).alias("selector"), found.alias("blocks"))))

    keys = [c for c in pages.columns if c != html]
    chosen = lambda pieces: F.coalesce(*[choice(i, s, pieces) for i, s in enumerate(selectors, 1)])
    found = let(pieces_of(F.col(html)), chosen) if any(isinstance(s, Element) for s in selectors) else chosen(None)
    return (
        visible.select(*keys, found.alias("found"))
        .select(*keys, "found.selector", F.posexplode_outer("found.blocks").alias("pos", "block"))
        .where(F.col("pos").isNotNull())
        .select(*keys, "selector", "pos", "block.opening", "block.body")
    )


def review_fields(blocks: DataFrame) -> DataFrame:
    """Raw strings of each review block, by the page's markup."""
    hook = lambda name, value: Element(name, "data-hook", value)
    span = Element("span")

    # Fixed values below: the elements and attributes that hold a review's fields.
    def fields(pieces: Column) -> Column:
        first = lambda e: first_element(pieces, e)
        return F.struct(
            text_of(first(Element("span", "class", "a-profile-name", "word"))).alias("reviewer_name"),
            text_of(first(hook("span", "helpful-vote-statement"))).alias("helpful_text"),
            text_of(last_element(first(hook("a", "review-title")), span)).alias("title"),
            text_of(first(hook("i", "review-star-rating"))).alias("rating_text"),
            text_of(first_element(first(hook("div", "review-collapsed")), span)).alias("reviewText"),
            text_of(first(hook("span", "review-date"))).alias("date_text"),
        )

    keys = [c for c in blocks.columns if c not in ("opening", "body")]
    review_id = parse_review_id(attribute(F.col("opening"), "id"))
    # A list of one, taken apart again: what reads the fields later works on them, not on copies of how they are made.
    made = F.explode_outer(F.array(let(pieces_of(F.col("body")), fields)))
    return blocks.select(*keys, review_id.alias("review_id"), made.alias("f")).select(*keys, "review_id", "f.*")


def parse_fields(raw: DataFrame) -> DataFrame:
    """Typed record fields, and ``reject_reason`` naming the first field that could not be read."""
    parsed = raw.select(
        "*",
        parse_rating(F.col("rating_text")).alias("overall"),
        parse_review_date(F.col("date_text")).alias("date"),
        parse_helpful(F.col("helpful_text")).alias("_votes"),
    )
    reason = (
        F.when(F.col("reviewer_name").isNull(), "reviewer_name")
        .when(F.col("title").isNull(), "title")
        .when(F.col("overall").isNull(), "rating")
        .when(F.col("reviewText").isNull(), "text")
        .when(F.col("date").isNull(), "date")
        .when(F.col("_votes").isNull(), "helpful")
    )
    return parsed.select(
        *[c for c in parsed.columns if c != "_votes"],
        F.get("_votes", F.lit(0)).alias("helpful_votes"),
        F.get("_votes", F.lit(1)).alias("total_votes"),
        reason.alias("reject_reason"),
    )


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and the records that could not be read with the reason."""
    good = parsed.where("reject_reason IS NULL").drop("reject_reason")
    return good, parsed.where("reject_reason IS NOT NULL")


def extract_reviews(pages: DataFrame, scrape_time: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Records for the raw topic from product pages (``asin``, ``html``), and the rejects."""
    now = F.current_timestamp() if scrape_time is None else scrape_time
    parsed = parse_fields(review_fields(extract_blocks(pages, REVIEW_SELECTORS)))
    good, rejects = split_rejects(parsed)
    records = good.select(
        "reviewer_name",
        "asin",
        "review_id",
        "title",
        "overall",
        "reviewText",
        "date",
        "helpful_votes",
        "total_votes",
        F.date_format(now, "yyyy-MM-dd HH:mm").alias("scrape_time"),
    )
    return records, rejects
