"""Elements of page source, and reviews in markup that nests."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from opinara.functions import markup
from opinara.operators import extraction


class Tree(HTMLParser):
    """Texts of all elements of one name and class word, by a stack, for markup that is closed in order."""

    def __init__(self, name, word):
        super().__init__()
        self.name, self.word, self.open, self.texts = name, word, [], []

    def handle_starttag(self, tag, attrs):
        hit = tag == self.name and self.word in (dict(attrs).get("class") or "").split()
        if hit:
            self.texts.append("")
        self.open.append(len(self.texts) - 1 if hit else None)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        for k in self.open:
            if k is not None:
                self.texts[k] += data


def _random_markup(rng, depth=0):
    parts = []
    for _ in range(rng.randint(0, 4)):
        if depth > 5 or rng.random() < 0.4:
            parts.append(rng.choice(["a ", "b", "1 &lt; 2", "x > y", "é"]))
        else:
            name, quote = rng.choice(["div", "span", "i"]), rng.choice("'\"")
            word = rng.choice(["", f" class={quote}w{quote}", f" title='<div class=w>' class={quote}u w v{quote}", f" class={quote}ww{quote}", " CLASS=w"])
            parts.append(f"<{name}{word}>{_random_markup(rng, depth + 1)}</{name}>")
    return "".join(parts)


def test_elements_equal_a_parsers(spark):
    rng = random.Random(1)
    pages = [f"<div class=w>{_random_markup(rng)}</div>{_random_markup(rng)}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    found = markup.elements(markup.pieces_of(F.col("html")), markup.Element("div", "class", "w", "word"))
    rows = df.select("i", F.transform(found, markup.text_of).alias("texts")).collect()
    for i, texts in rows:
        tree = Tree("div", "w")
        tree.feed(pages[i])
        assert texts == [x.strip() for x in tree.texts], pages[i]


def test_running_sum_over_chunks(spark):
    steps = [random.Random(2).choice([-1, 0, 1]) for _ in range(1000)]
    df = spark.createDataFrame([(steps,), ([],), (steps[:64],), (steps[:65],)], "steps array<int>")
    sums = [[sum(r.steps[: i + 1]) for i in range(len(r.steps))] for r in df.collect()]
    assert [r.s for r in df.select(markup.running_sum(F.col("steps")).alias("s")).collect()] == sums


def test_many_tags_in_linear_time(spark):
    page = "<div class='w'>" + "<div><span>x</span>" * 20_000 + "</div>" * 20_000 + "end</div>after"
    df = spark.createDataFrame([(page,)], "html string")
    found = markup.first_element(markup.pieces_of(F.col("html")), markup.Element("div", "class", "w", "word"))
    assert df.select(markup.text_of(found).alias("t")).first().t == "x" * 20_000 + "end"


REVIEW = (
    '<div data-hook="review" id="customer_review-1">{name}<a data-hook="review-title"><span>T</span></a><i data-hook="review-star-rating">4.0 out of 5</i>'
    '{date}<div data-hook="review-collapsed"><span>{text}</span></div></div><footer><span data-hook="review-date">on May 5, 2020</span></footer>'
)
NAME, DATE = '<span class="a-profile-name">A</span>', '<span data-hook="review-date">on March 5, 2024</span>'


@pytest.mark.parametrize(
    "name, date, text, expected",
    [
        (NAME, DATE, "one <span>two</span> three", ("A", "one two three", "2024-03-05")),
        (NAME, "", "t", "date"),
        ("<span class='a-profile-name'>A</span>", DATE, "t", ("A", "t", "2024-03-05")),
        ('<span class="a-profile-name x">A</span>', DATE, "t", ("A", "t", "2024-03-05")),
        ('<span class="not-a-profile-name">A</span>', DATE, "t", "reviewer_name"),
    ],
)
def test_reviews_in_nested_markup(spark, name, date, text, expected):
    pages = spark.createDataFrame([("B", REVIEW.format(name=name, date=date, text=text))], "asin string, html string")
    good, rejects = extraction.extract_reviews(pages)
    found = [(r.reviewer_name, r.reviewText, r.date) for r in good.collect()] + [r.reject_reason for r in rejects.collect()]
    assert found == [expected]
