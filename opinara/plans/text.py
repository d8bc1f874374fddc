"""Queries on document text and raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import parsing
from opinara.functions import text as tx
from opinara.functions.stopwords import STOP_WORDS
from opinara.operators import extraction, features, normalise
from opinara.plans import tables as t
from opinara.plans.registry import query
from opinara.sources.readers import spread
from opinara.workspace import stored

RV = "WITH " + t.REVIEWS_SQL + "\n"
RD = "WITH " + t.DOCUMENTS_SQL + "\n"


def _clean_sql(column: str) -> str:
    """The cleaning steps for an automaton-based engine, which needs no guards against backtracking."""
    steps = [
        r"\[[^\n]*?\]",
        rf"https?://[^{tx.SPACE}]+|www\.[^{tx.SPACE}]+",
        r"<[^\n]*?>+",
        r"[!-/:-@\[-`{-~]",
        r"\n",
        rf"[{tx.WORD}]*\p{{Nd}}[{tx.WORD}]*",
    ]
    sql = f"lower({column})"
    for step in steps:
        sql = f"regexp_replace({sql}, '{step}', '', 'g')"
    return sql


_SPLIT = r"CASE WHEN {0} = '' THEN [''] WHEN rtrim({0}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN [] ELSE string_split_regex(rtrim({0}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \t\n\x0b\f\r]') END"
CLEAN = "cl AS (SELECT doc_id, " + _clean_sql("text") + " AS reviews FROM documents)"
_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
TOKENS = CLEAN + ", tk AS (SELECT doc_id, " + _SPLIT.format("reviews") + " AS words FROM cl)"
WORDS = TOKENS + f", wd AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(words) AS word FROM tk) WHERE word NOT IN ({_STOPS}))"
#: Counts of the documents' terms, as ``tf``, without the leading WITH.
TERM_COUNTS = WORDS + ", tf AS (SELECT doc_id, word AS term, count(*) AS tf FROM wd GROUP BY 1, 2)"


def words_sql(name: str, texts: str) -> str:
    """The term counts of other texts: ``texts`` selects doc_id and text, ``name`` names the counts."""
    cleaned = f"{name}_c AS (SELECT doc_id, {_clean_sql('text')} AS reviews FROM ({texts}))"
    words = f"{name}_t AS (SELECT doc_id, unnest({_SPLIT.format('reviews')}) AS term FROM {name}_c)"
    return f"{cleaned}, {words}, {name} AS (SELECT doc_id, term, count(*) AS tf FROM {name}_t WHERE term NOT IN ({_STOPS}) GROUP BY 1, 2)"


TERMS = (
    WORDS
    + """, tf AS (SELECT doc_id, word AS term, count(*) AS tf FROM wd GROUP BY 1, 2),
df AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df, (SELECT count(*) FROM documents) AS m FROM tf GROUP BY term),
vocab AS (SELECT * FROM df WHERE df >= 5 AND df <= 0.8 * m),
idf AS (SELECT term, df, ln((m + 1) / (df + 1)) AS idf FROM vocab)"""
)


@query("fill_missing_text", RD + "SELECT doc_id, coalesce(kept_text, 'Missing') AS kept_text, summary FROM rd")
def fill_missing_text(spark, sf):
    return normalise.fill_missing(t.documents(spark, sf).select("doc_id", "kept_text", "summary"), ["kept_text"])


@query("fill_empty_text", RD + "SELECT doc_id, coalesce(kept_text, '') AS kept_text, coalesce(summary, '') AS summary FROM rd")
def fill_empty_text(spark, sf):
    return normalise.fill_empty(t.documents(spark, sf).select("doc_id", "kept_text", "summary"), ["kept_text", "summary"])


@query("concat_review", RD + "SELECT doc_id, coalesce(review_text, 'Missing') || summary AS reviews FROM rd")
def concat_review(spark, sf):
    filled = normalise.fill_missing(t.documents(spark, sf), ["review_text"])
    return filled.select("doc_id", tx.concat_review(F.col("review_text"), F.col("summary")).alias("reviews"))


@query("clean_text", "WITH " + CLEAN + " SELECT doc_id, reviews FROM cl")
def clean_text(spark, sf):
    return t.texts(spark, sf).select("doc_id", tx.clean_text(F.col("review_text")).alias("reviews"))


@query("clean_pages", "SELECT page_id, " + _clean_sql("html") + " AS reviews FROM pages")
def clean_pages(spark, sf):
    return spread(t.table(spark, sf, "pages")).select("page_id", tx.clean_text(F.col("html")).alias("reviews"))


@query("review_len", "WITH " + CLEAN + " SELECT doc_id, CAST(length(reviews) AS INTEGER) AS review_len FROM cl")
def review_len(spark, sf):
    return clean_text(spark, sf).select("doc_id", tx.review_len(F.col("reviews")).alias("review_len"))


@query("word_count", "WITH " + CLEAN + f" SELECT doc_id, CAST(len(regexp_extract_all(reviews, '[^{tx.SPACE}]+')) AS INTEGER) AS word_count FROM cl")
def word_count(spark, sf):
    return clean_text(spark, sf).select("doc_id", tx.word_count(F.col("reviews")).alias("word_count"))


@query("tokens", "WITH " + TOKENS + " SELECT doc_id, CAST(len(words) AS INTEGER) AS n, array_to_string(words, '|') AS words FROM tk")
def tokens(spark, sf):
    words = clean_text(spark, sf).select("doc_id", tx.tokens(F.col("reviews")).alias("words"))
    return words.select("doc_id", F.size("words").alias("n"), F.array_join("words", "|").alias("words"))


def _filtered(spark, sf):
    return features.filtered_tokens(clean_text(spark, sf), "reviews").select("doc_id", "words")


@query("filtered_tokens", "WITH " + WORDS + " SELECT word, count(*) AS n FROM wd GROUP BY word")
def filtered_tokens(spark, sf):
    words = features.explode_words(_filtered(spark, sf), "doc_id")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _counts(spark, sf):
    return features.term_counts(_filtered(spark, sf), "doc_id")


def _vocabulary(spark, sf):
    return features.vocabulary(_counts(spark, sf), t.table(spark, sf, "documents"))


@query("vocabulary", "WITH " + TERMS + " SELECT term, tf, df FROM vocab")
def vocabulary(spark, sf):
    return _vocabulary(spark, sf).select("term", "tf", "df")


@query("idf_weights", "WITH " + TERMS + " SELECT term, df, round(idf, 9) AS idf FROM idf")
def idf_weights(spark, sf):
    return features.idf_weights(_vocabulary(spark, sf)).withColumn("idf", F.round("idf", 9))


@query("tfidf", "WITH " + TERMS + " SELECT tf.doc_id, tf.term, round(tf.tf * idf.idf, 9) AS tfidf FROM tf JOIN idf ON tf.term = idf.term")
def tfidf(spark, sf):
    # Counted once, as a table, which the weights and the join with them both read.
    counts = stored(_counts(spark, sf), "term-counts")
    weights = features.idf_weights(features.vocabulary(counts, t.table(spark, sf, "documents")))
    return features.tfidf(counts, stored(weights, "idf-weights"), "doc_id").withColumn("tfidf", F.round("tfidf", 9))


# A user's word scores; these are frequent words of the documents.
LEXICON = {
    "not": -0.5, "thand": 0.25, "nd": 0.125, "er": -0.25, "re": 0.5, "on": 0.25, "tion": 0.75, "le": -0.125,
    "que": 0.5, "de": -0.75, "der": 0.375, "die": -1.0, "und": 0.25, "la": 1.0, "los": -0.375, "en": 0.125,
}
_LEXICON_SQL = "lx(word, polarity) AS (VALUES " + ", ".join(f"('{w}', CAST({p} AS DOUBLE))" for w, p in LEXICON.items()) + ")"


def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "word string, polarity double")


@query(
    "lexicon_polarity",
    "WITH "
    + TOKENS
    + ", "
    + _LEXICON_SQL
    + """, x AS (SELECT doc_id, unnest(words) AS word FROM tk), s AS (SELECT doc_id, avg(polarity) AS p FROM x JOIN lx ON x.word = lx.word GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.p, 0.0) AS polarity FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""",
)
def lexicon_polarity(spark, sf):
    words = clean_text(spark, sf).select("doc_id", tx.tokens(F.col("reviews")).alias("words"))
    return features.lexicon_polarity(words, lexicon(spark), "doc_id")


@query(
    "feature_table",
    "WITH "
    + t.DOCUMENTS_SQL
    + ", "
    + TOKENS
    + ", "
    + _LEXICON_SQL
    + f""", x AS (SELECT doc_id, unnest(words) AS word FROM tk), s AS (SELECT doc_id, avg(polarity) AS p FROM x JOIN lx ON x.word = lx.word GROUP BY doc_id)
SELECT rd.doc_id, cl.reviews, coalesce(s.p, 0.0) AS polarity, CAST(length(cl.reviews) AS INTEGER) AS review_len,
       CAST(len(regexp_extract_all(cl.reviews, '[^{tx.SPACE}]+')) AS INTEGER) AS word_count,
       CASE WHEN overall = 3 THEN 1 WHEN overall IN (1, 2) THEN 0 ELSE 2 END AS sentiment
FROM rd JOIN cl ON rd.doc_id = cl.doc_id LEFT JOIN s ON rd.doc_id = s.doc_id""",
)
def feature_table(spark, sf):
    from opinara.functions.labels import label_from_rating

    labelled = t.documents(spark, sf).withColumn("sentiment", label_from_rating(F.col("overall")))
    return features.feature_table(labelled, "doc_id", "review_text", lexicon(spark))


# Pages

_VISIBLE_SQL = (
    r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g')"
)


def _unescape_sql(column: str) -> str:
    return (
        f"replace(replace(replace(replace({column}, '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')"
    )


@query(
    "extract_links",
    f"""WITH v AS (SELECT page_id, url, {_VISIBLE_SQL} AS html FROM pages),
a AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*?\\bhref="([^"]*)"', 1) AS hrefs FROM v),
u AS (SELECT page_id, url, unnest(hrefs) AS raw, unnest(range(len(hrefs))) AS pos FROM a),
h AS (SELECT page_id, url, pos, {_unescape_sql("raw")} AS href FROM u WHERE contains(raw, '/'))
SELECT page_id, url, CAST(pos AS INTEGER) AS pos, CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || href END AS link,
       split_part(substr(href, strpos(href, '/') + 1), '/', 1) AS id FROM h""",
)
def extract_links(spark, sf):
    return extraction.extract_links(spread(t.table(spark, sf, "pages")), marker="/")


@query(
    "extract_blocks",
    f"""WITH v AS (SELECT page_id, {_VISIBLE_SQL} AS html FROM pages),
s AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<section\\b[^>]*>') THEN 1 WHEN regexp_matches(html, '(?i)<p\\b[^>]*>') THEN 2
  WHEN regexp_matches(html, '(?i)<li\\b[^>]*>') THEN 3 END AS selector, html FROM v),
b AS (SELECT page_id, selector, string_split_regex(html, CASE selector WHEN 1 THEN '(?i)<section\\b[^>]*>' WHEN 2 THEN '(?i)<p\\b[^>]*>' ELSE '(?i)<li\\b[^>]*>' END)[2:] AS bodies
  FROM s WHERE selector IS NOT NULL),
u AS (SELECT page_id, selector, unnest(bodies) AS body, unnest(range(len(bodies))) AS pos FROM b)
SELECT page_id, selector, CAST(pos AS INTEGER) AS pos, string_split_regex(body, CASE selector WHEN 1 THEN '(?i)</section>' WHEN 2 THEN '(?i)</p>|</article>' ELSE '(?i)</li>' END)[1] AS body FROM u""",
)
def extract_blocks(spark, sf):
    selectors = [
        extraction.Selector(r"(?i)<section\b[^>]*>", r"(?i)</section>"),
        extraction.Selector(r"(?i)<p\b[^>]*>", r"(?i)</p>|</article>"),
        extraction.Selector(r"(?i)<li\b[^>]*>", r"(?i)</li>"),
    ]
    pages = spread(t.table(spark, sf, "pages").select("page_id", "html"))
    return extraction.extract_blocks(pages, selectors).select("page_id", "selector", "pos", "body")


_TRIMMED = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"


def _escaped(text):
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


@query(
    "extract_reviews",
    f"""SELECT source AS asin, 'R' || doc_id AS review_id, lang AS reviewer_name, 'Title of ' || doc_id AS title, CAST(1 + doc_id % 5 AS DOUBLE) AS overall,
{_TRIMMED.format("text")} AS "reviewText", '2024-03-05' AS date, CAST(doc_id % 4 AS INTEGER) AS helpful_votes, CAST(doc_id % 4 AS INTEGER) AS total_votes
FROM documents WHERE doc_id % 7 <> 0""",
)
def extract_reviews(spark, sf):
    """Product pages around the documents' texts, as a shop writes them: texts in nested elements, either kind of quotes, several
    classes, and a footer with a date of its own; every seventh review has no rating that can be read."""
    i, n = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    votes = F.when(n == 0, "").when(n == 1, "One person found this helpful").otherwise(F.concat(n.cast("string"), F.lit(" people found this helpful")))
    rating = F.when(F.col("doc_id") % 7 == 0, "no stars").otherwise(F.concat((1 + F.col("doc_id") % 5).cast("string"), F.lit(",0 out of 5 stars")))
    half = F.floor(F.length("text") / 2).cast("int")
    html = F.format_string(
        "<html><body><script>var a = '<div data-hook=\"review\">';</script><div id='customer_review-R%s' data-hook='review'><div class=x>"
        "<span class='a-profile-name y'>%s</span></div><a title='a > b' data-hook=\"review-title\"><span>5</span><span><b>Title</b> of %s</span></a>"
        '<i data-hook="review-star-rating"><span>%s</span></i><span data-hook="review-date"><span>Reviewed</span> on March 5, 2024</span>'
        '<div data-hook="review-collapsed"><span>%s<span class="z">%s</span></span><span>more</span></div><span data-hook="helpful-vote-statement">%s</span></div>'
        '<div><span data-hook="review-date">Updated on May 5, 2020</span></div></body></html>',
        i, F.col("lang"), i, rating, _escaped(F.substr("text", F.lit(1), half)), _escaped(F.substr("text", half + 1)), votes,
    )
    pages = t.table(spark, sf, "documents").select(F.col("source").alias("asin"), html.alias("html"))
    return extraction.extract_reviews(pages)[0].drop("scrape_time")


@query(
    "extract_undated_reviews",
    """SELECT source AS asin, 'R' || doc_id AS review_id, lang AS reviewer_name,
CASE WHEN doc_id % 3 = 0 THEN 'date' WHEN doc_id % 3 = 1 THEN 'title' ELSE 'rating' END AS reject_reason FROM documents""",
)
def extract_undated_reviews(spark, sf):
    """Pages whose last review lacks a field that the page has again after it; none of these fills the gap."""
    i = F.col("doc_id").cast("string")
    date, title, rating = (F.when(F.col("doc_id") % 3 != k, part).otherwise("") for k, part in enumerate(
        ('<span data-hook="review-date">on March 5, 2024</span>', '<a data-hook="review-title"><span>T</span></a>', '<i data-hook="review-star-rating">4.0 out of 5</i>')
    ))
    footer = '<div><span data-hook="review-date">on May 5, 2020</span><a data-hook="review-title"><span>No</span></a><i data-hook="review-star-rating">1.0 out of 5</i></div>'
    html = F.format_string(
        "<div id='customer_review-R%s' data-hook=review><span class=\"a-profile-name\">%s</span>%s%s%s"
        f'<div data-hook="review-collapsed"><div><span>%s</span></div></div></div>{footer}',
        i, F.col("lang"), date, title, rating, _escaped(F.col("text")),
    )
    pages = t.table(spark, sf, "documents").select(F.col("source").alias("asin"), html.alias("html"))
    return extraction.extract_reviews(pages)[1].select("asin", "review_id", "reviewer_name", "reject_reason")


@query(
    "extract_card_links",
    """SELECT source, doc_id, CAST(k AS INTEGER) AS pos, CASE k WHEN 0 THEN 'https://shop.example' ELSE 'https://other.example' END || '/dp/' || lang || doc_id || CASE k WHEN 0 THEN '/ref' ELSE '' END AS link,
lang || doc_id AS id FROM documents, range(2) AS r(k) WHERE doc_id % 5 <> 0 OR k = 0""",
)
def extract_card_links(spark, sf):
    """Lists of products: one link per card, the first to a product, whatever else is in the card, before the cards or after them."""
    card, i = extraction.CARD, F.concat("lang", "doc_id")
    second = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("<a href=https://other.example/dp/"), i, F.lit(">x</a>")))
    html = F.format_string(
        f"<a href='/dp/before/'>n</a><div class='{card}'><div><a href='/help'>h</a></div><div><a class=l href='/dp/%s/ref'><img alt='>'></a></div><a href='/dp/again/'>a</a></div>"
        f"<div class=\"grid {card}\"><div>%s</div></div><div><a href='/dp/after/'>f</a></div>",
        i, second,
    )
    pages = t.table(spark, sf, "documents").select("source", "doc_id", F.lit("https://shop.example/list").alias("url"), html.alias("html"))
    return extraction.extract_links(pages, card=card).drop("url")


@query(
    "extract_title",
    f"""WITH v AS (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS raw FROM pages)
SELECT page_id, trim({_unescape_sql("regexp_replace(raw, '<[^>]*>', '', 'g')")}) AS title FROM v""",
)
def extract_title(spark, sf):
    raw = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return t.table(spark, sf, "pages").select("page_id", parsing.element_text(raw).alias("title"))


_HELPFUL_SQL = """, h AS (SELECT review_id, helpful_votes AS v, ord_hint AS o FROM rv),
s AS (SELECT review_id, v, o, CASE v WHEN 1 THEN 'One person found this helpful' WHEN 2 THEN NULL WHEN 3 THEN 'Helpful'
  WHEN 4 THEN v || ' of ' || (v + o) || ' people found this helpful' ELSE (v + o) || ' people found this helpful' END AS helpful_text FROM h)
"""


@query(
    "parse_helpful",
    RV
    + _HELPFUL_SQL
    + """SELECT review_id, helpful_text, CAST(CASE v WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN v ELSE v + o END AS INTEGER) AS helpful_votes,
CAST(CASE v WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE v + o END AS INTEGER) AS total_votes FROM s""",
)
def parse_helpful(spark, sf):
    v, both = F.col("helpful_votes"), (F.col("helpful_votes") + F.col("ord_hint")).cast("string")
    people = F.lit(" people found this helpful")
    statement = (
        F.when(v == 1, "One person found this helpful")
        .when(v == 2, F.lit(None))
        .when(v == 3, "Helpful")
        .when(v == 4, F.concat(v.cast("string"), F.lit(" of "), both, people))
        .otherwise(F.concat(both, people))
    )
    votes = t.facts_only(spark, sf).select("review_id", statement.alias("helpful_text"))
    parsed = votes.withColumn("votes", parsing.parse_helpful(F.col("helpful_text")))
    return parsed.select(
        "review_id", "helpful_text", F.get("votes", F.lit(0)).alias("helpful_votes"), F.get("votes", F.lit(1)).alias("total_votes")
    )


@query("parse_rating", RV + "SELECT review_id, overall, overall AS parsed FROM rv")
def parse_rating(spark, sf):
    text = F.concat(F.replace(F.col("overall").cast("string"), F.lit("."), F.lit(",")), F.lit(" out of 5 stars"))
    return t.facts_only(spark, sf).select("review_id", "overall", parsing.parse_rating(text).alias("parsed"))


@query("parse_review_date", RV + "SELECT review_id, strftime(review_ts, '%Y-%m-%d') AS date FROM rv")
def parse_review_date(spark, sf):
    text = F.concat(F.lit("Reviewed in the United States on "), F.date_format("review_ts", "MMMM d, yyyy"))
    return t.facts_only(spark, sf).select("review_id", parsing.parse_review_date(text).alias("date"))


@query("parse_review_id", RV + "SELECT 'customer_review-' || review_id AS element_id, review_id FROM rv")
def parse_review_id(spark, sf):
    element = F.concat(F.lit("customer_review-"), F.col("review_id"))
    return t.facts_only(spark, sf).select(element.alias("element_id"), parsing.parse_review_id(element).alias("review_id"))


def _raw_fields(spark, sf):
    rating = F.when(F.col("overall").isNotNull(), F.concat(F.col("overall").cast("string"), F.lit(" out of 5 stars"))).otherwise("unrated")
    return t.documents(spark, sf).select(
        "doc_id",
        F.col("lang").alias("reviewer_name"),
        F.col("summary").alias("title"),
        rating.alias("rating_text"),
        F.col("review_text").alias("reviewText"),
        F.lit("Reviewed on March 5, 2024").alias("date_text"),
        F.lit(None).cast("string").alias("helpful_text"),
    )


_RAW = """, p AS (SELECT doc_id, CASE WHEN summary IS NULL THEN 'title' WHEN overall IS NULL THEN 'rating' WHEN review_text IS NULL THEN 'text' END AS reject_reason,
  lang, summary, overall, review_text FROM rd)
"""


@query("extract_rejects", RD + _RAW + "SELECT doc_id, reject_reason FROM p WHERE reject_reason IS NOT NULL")
def extract_rejects(spark, sf):
    _, rejects = extraction.split_rejects(extraction.parse_fields(_raw_fields(spark, sf)))
    return rejects.select("doc_id", "reject_reason")


@query(
    "extract_records",
    RD
    + _RAW
    + """SELECT doc_id, lang AS reviewer_name, summary AS title, overall, review_text AS reviewText, '2024-03-05' AS date, 0 AS helpful_votes, 0 AS total_votes
FROM p WHERE reject_reason IS NULL""",
)
def extract_records(spark, sf):
    good, _ = extraction.split_rejects(extraction.parse_fields(_raw_fields(spark, sf)))
    return good.select("doc_id", "reviewer_name", "title", "overall", "reviewText", "date", "helpful_votes", "total_votes")
