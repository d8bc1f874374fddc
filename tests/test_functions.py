"""Edge rows of the column functions, and their equality with plain Python or the ML transformers."""

import re
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import IDF, CountVectorizer, StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from opinara.functions import labels, parsing
from opinara.functions import text as tx
from opinara.functions.sql import register_sql_functions
from opinara.functions.stopwords import STOP_WORDS
from opinara.operators import features, modelling
from opinara.plans import tables as t
from opinara.plans import text as text_queries

EDGE = "Héllo1 wörld [a\nb] <i>x</i>> http://a.b/c?d=1 www.x.com né2é ٣abc $+<=>^~ end"


# The patterns of the cleaning steps, in their order.
def python_clean(text):
    text = str(text).lower()
    for pattern in (
        r"\[.*?\]",
        r"https?://\S+|www\.\S+",
        r"<.*?>+",
        "[" + re.escape(string.punctuation) + "]",
        "\n",
        r"\w*\d\w*",
    ):
        text = re.sub(pattern, "", text)
    return text


def test_clean_text_edge_row(one, c):
    assert one(tx.clean_text(c), c=EDGE) == python_clean(EDGE) == " wörld ab x      end"
    assert one(tx.clean_text(c), c=None) == "none"


def test_clean_text_equals_python_on_documents_and_pages(spark, sf_dir):
    for name, column in (("documents", "text"), ("pages", "html")):
        rows = t.table(spark, sf_dir, name).select(F.col(column).alias("raw"), tx.clean_text(F.col(column)).alias("x"))
        for row in rows.collect():
            assert row["x"] == python_clean(row["raw"])


PIECES = st.sampled_from(
    ["[", "]", "<", ">", "http://", "https://x", "www.", "\n", " ", "\t", "\x85", "\xa0", " ", "\x1c", "a", "É", "9", "²", "٣", "ж7", "_", "é", ".", "-", "&"]
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=20, max_size=40))
def test_clean_text_equals_python_on_junk(spark, texts):
    rows = spark.createDataFrame([(x,) for x in texts], "raw string")
    cleaned = rows.select("raw", tx.clean_text(F.col("raw")).alias("x"), tx.word_count(F.col("raw")).alias("n")).collect()
    assert [r["x"] for r in cleaned] == [python_clean(r["raw"]) for r in cleaned]
    assert [r["n"] for r in cleaned] == [len(r["raw"].split()) for r in cleaned]


def test_clean_text_is_linear_on_long_junk(one, c):
    junk = "x" * 400_000 + " " + "a1" * 100_000
    assert one(F.length(tx.clean_text(c)), c=junk) == 400_001


@pytest.mark.parametrize("text, words", [("a  b ", ["a", "", "b"]), ("", [""]), (" x", ["", "x"]), ("  ", []), ("A\tb", ["a", "b"])])
def test_tokens(spark, c, one, text, words):
    assert one(tx.tokens(c), c=text) == words
    row = spark.createDataFrame([(text,)], "c string")
    assert Tokenizer(inputCol="c", outputCol="w").transform(row).first()["w"] == words


def test_tokens_and_stop_words_equal_transformers(spark, sf_dir):
    cleaned = t.texts(spark, sf_dir).select("doc_id", tx.clean_text(F.col("review_text")).alias("reviews"))
    words = Tokenizer(inputCol="reviews", outputCol="w").transform(cleaned)
    kept = StopWordsRemover(inputCol="w", outputCol="k", stopWords=STOP_WORDS).transform(words)
    own = tx.tokens(F.col("reviews"))
    assert kept.where((own != F.col("w")) | (tx.drop_stop_words(own) != F.col("k"))).count() == 0


def test_stop_words():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 131
    assert not {"not", "no", "nor", "but", "if"} & set(STOP_WORDS)


def test_word_count(one, c):
    assert one(tx.word_count(c), c="") == 0
    assert one(tx.word_count(c), c="a  b") == 2


def test_concat_review(one):
    a, b = F.col("a"), F.col("b")
    assert one(tx.concat_review(a, b), a="Missing", b="s") == "Missings"
    assert one(tx.concat_review(a, b), a="x", b=None) is None


@pytest.mark.parametrize("rating, code", [(3.0, 1), (1.0, 0), (2.5, 2), (0.0, 2)])
def test_label_from_rating(one, c, rating, code):
    assert one(labels.label_from_rating(c), c=rating) == code
    assert one(labels.label_from_rating(c, strict=True), c=rating) == code


def test_label_of_missing_rating(one, c):
    rating = c.cast("double")
    assert one(labels.label_from_rating(rating), c=None) == 2
    assert one(labels.label_from_rating(rating, strict=True), c=None) is None


def test_sentiment_label(one, c):
    assert [one(labels.sentiment_label(c), c=i) for i in (0, 1, 2, 7)] == ["Negative", "Neutral", "Positive", "Positive"]
    assert one(labels.sentiment_label(c, strict=True), c=7) is None


@pytest.mark.parametrize("value, category", [("2", "positive"), ("1.0", "neutral"), ("Negative", "negative"), ("odd", None), (None, None)])
def test_canonical_category(one, c, value, category):
    assert one(labels.canonical_category(c), c=value) == category
    assert one(labels.canonical_category(c, unknown="neutral"), c=value) == (category or "neutral")


def test_canonical_category_by_label(one, c):
    assert one(labels.canonical_category(F.col("s"), F.col("l")), s=None, l="Positive") == "positive"
    with pytest.raises(ValueError):
        labels.canonical_category(c, unknown="other")


@pytest.mark.parametrize("part, total, percent", [(1, 8, 13), (0, 0, 0), (29, 200, 14), (1, 3, 33)])
def test_integer_percent(one, part, total, percent):
    assert one(labels.integer_percent(F.col("p"), F.col("t")), p=part, t=total) == percent


@pytest.mark.parametrize(
    "text, votes",
    [
        (None, [0, 0]),
        ("One person found this helpful", [1, 1]),
        ("12 people found this helpful", [12, 12]),
        ("1,234 people found this helpful", [1234, 1234]),
        ("3 of 5 people found this helpful", [3, 5]),
        ("many people found this helpful", None),
        ("Report", [0, 0]),
    ],
)
def test_parse_helpful(one, c, text, votes):
    assert one(parsing.parse_helpful(c), c=text) == votes


@pytest.mark.parametrize("text, stars", [("4,0 out of 5 stars", 4.0), ("3.5 out of 5", 3.5), ("x", None), ("", None)])
def test_parse_rating(one, c, text, stars):
    assert one(parsing.parse_rating(c), c=text) == stars


@pytest.mark.parametrize(
    "text, day",
    [
        ("Reviewed in the United States on March 5, 2024", "2024-03-05"),
        ("Reviewed on London on December 31, 1999", "1999-12-31"),
        ("x", None),
        ("on February 30, 2024", None),
    ],
)
def test_parse_review_date(one, c, text, day):
    assert one(parsing.parse_review_date(c), c=text) == day


def test_parse_review_id(one, c):
    assert one(parsing.parse_review_id(c), c="customer_review-R1") == "R1"
    assert one(parsing.parse_review_id(c), c="R1") == "R1"


@pytest.mark.parametrize(
    "html, text",
    [
        ("a &amp; b", "a & b"),
        ("&amp;quot;", "&quot;"),
        ("&#233;&#xe9;&eacute;", "ééé"),
        ("&#128512;", "\U0001f600"),
        ("&unknown; & &", "&unknown; & &"),
        ("&#0;&#55296;&#99999999;", "&#0;&#55296;&#99999999;"),
        ("it&apos;s &#146;x&#x80; &hellip;&NotEqualTilde;", "it's \u2019x\u20ac \u2026\u2242\u0338"),
        ("plain", "plain"),
        ("&&amp;x", "&&x"),
    ],
)
def test_unescape_html(one, c, html, text):
    assert one(parsing.unescape_html(c), c=html) == text


def test_element_text(one, c):
    assert one(parsing.element_text(c), c=" \n<b>Good&nbsp;one</b> <i>!</i>\xa0\n") == "Good\xa0one !"


def test_sql_functions(spark):
    register_sql_functions(spark)
    spark.createDataFrame([(EDGE, 1)], "t string, n int").createOrReplaceTempView("edge")
    row = spark.sql("SELECT clean_text(t) AS t, sentiment_label(n) AS l FROM edge").first()
    assert (row["t"], row["l"]) == (python_clean(EDGE), "Neutral")


def test_tfidf_equals_transformers(spark, sf_dir):
    cleaned = t.texts(spark, sf_dir).select("doc_id", tx.clean_text(F.col("review_text")).alias("reviews"))
    words = features.filtered_tokens(cleaned, "reviews")
    counts = features.term_counts(words, "doc_id")
    vocab = features.vocabulary(counts, words)
    own = {(r["doc_id"], r["term"]): r["tfidf"] for r in features.tfidf(counts, features.idf_weights(vocab), "doc_id").collect()}
    cv = CountVectorizer(inputCol="words", outputCol="raw", maxDF=0.8, minDF=5).fit(words)
    raw = cv.transform(words)
    terms, theirs = cv.vocabulary, {}
    for r in IDF(inputCol="raw", outputCol="f", minDocFreq=5).fit(raw).transform(raw).select("doc_id", "f").collect():
        for i, v in zip(r["f"].indices, r["f"].values):
            theirs[(r["doc_id"], terms[i])] = float(v)
    assert own.keys() == theirs.keys() and len(own) > 1000
    assert all(abs(own[k] - theirs[k]) < 1e-9 for k in own)


def test_term_counts_without_words(spark):
    rows = spark.createDataFrame([(1, []), (2, ["b", "a", "b", ""]), (3, None)], "id int, words array<string>")
    assert sorted(map(tuple, features.term_counts(rows, "id").collect())) == [(2, "", 1), (2, "a", 1), (2, "b", 2)]


def test_vocabulary_has_every_term_between_its_bounds(spark):
    rows = spark.createDataFrame([(i, ["a", "b", "b"] if i < 6 else ["a", f"rare{i}"]) for i in range(9)], "id int, words array<string>")
    vocab = features.vocabulary(features.term_counts(rows, "id"), rows, max_df=1.0)
    assert sorted((r["term"], r["tf"], r["df"], r["m"]) for r in vocab.collect()) == [("a", 9, 9, 9), ("b", 12, 6, 9)]
    assert "TakeOrdered" not in vocab._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="more than 1 terms"):
        texts = rows.select(F.concat(F.array_join("words", " "), F.when(F.col("id") < 6, " zed").otherwise("")).alias("reviews"))
        modelling.fit_features(texts, size=1)


def test_a_model_has_all_terms_however_many(spark):
    many = (1 << 18) + 500
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(many)), lambda i: F.translate(F.concat(F.lit("zz"), i.cast("string")), "0123456789", "abcdefghij")), " ")
    texts = spark.range(7).select(F.when(F.col("id") < 5, words).otherwise("other").alias("reviews"))
    assert len(modelling.fit_features(texts).stages[2].vocabulary) == many
    assert modelling.pipeline("NaiveBayes").getStages()[2].getVocabSize() > many


def test_weights_are_not_forced_to_be_broadcast(spark):
    rows = spark.createDataFrame([(1, ["a"])], "id int, words array<string>")
    counts = features.term_counts(rows, "id")
    weights = features.idf_weights(features.vocabulary(counts, rows, min_df=1, max_df=1.0))
    assert "hint" not in features.tfidf(counts, weights, "id")._jdf.queryExecution().optimizedPlan().toString().lower()


def test_feature_table_scans_once_and_moves_no_text(spark, sf_dir, monkeypatch):
    docs = t.documents(spark, sf_dir).select("doc_id", "review_text", F.lit(1).alias("sentiment"))
    lexicon = text_queries.lexicon(spark)
    got = features.feature_table(docs, "doc_id", "review_text", lexicon)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and "SortMergeJoin" not in plan
    monkeypatch.setattr(features, "IN_ROW", 3)
    joined = features.feature_table(docs, "doc_id", "review_text", lexicon)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joined.collect()))


def test_polarity_of_text_without_lexicon_words(spark):
    rows = spark.createDataFrame([(1, ["good", "bad", "good"]), (2, ["x"]), (3, [])], "id int, words array<string>")
    lexicon = spark.createDataFrame([("good", 0.5), ("bad", -1.0)], "word string, polarity double")
    assert dict(map(tuple, features.lexicon_polarity(rows, lexicon, "id").collect())) == {1: 0.0, 2: 0.0, 3: 0.0}
