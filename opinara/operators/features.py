"""Term statistics and polarity as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import clean_text, drop_stop_words, review_len, tokens, word_count
from opinara.workspace import stored

# Term statistics of the sentiment model.
MIN_DF = 5
MAX_DF = 0.8
#: Words of a lexicon that are looked up within the row; a longer lexicon is joined.
IN_ROW = 2_000


def filtered_tokens(df: DataFrame, text: str, name: str = "words") -> DataFrame:
    """Adds the tokens of a cleaned text without stop words."""
    return df.withColumn(name, drop_stop_words(tokens(F.col(text))))


def explode_words(df: DataFrame, key: str, words: str = "words") -> DataFrame:
    """``(key, word)``, one row per token.

    The outer generator keeps the optimizer from testing the list for rows first, which would build
    it twice.
    """
    return df.select(key, F.explode_outer(words).alias("word")).where(F.col("word").isNotNull())


def term_counts(df: DataFrame, key: str, words: str = "words") -> DataFrame:
    """``(key, term, tf)``, one row per distinct token of a text; ``key`` is unique per row of ``df``.

    A sorted token list holds equal tokens side by side, so runs are counted within the row and
    no token is shuffled. The generator is outer for the reason given in ``explode_words``.
    """
    tokens_sorted, starts = F.col("sorted"), F.col("starts")
    return (
        df.select(key, F.sort_array(words).alias("sorted"))
        .select(
            key,
            "sorted",
            F.filter(
                F.sequence(F.lit(0), F.size(tokens_sorted)),
                lambda i: (i == 0)
                | (i == F.size(tokens_sorted))
                | (F.get(tokens_sorted, i) != F.get(tokens_sorted, i - 1)),
            ).alias("starts"),
        )
        .select(
            key,
            F.transform(
                F.slice(starts, F.lit(1), F.size(starts) - 1),
                lambda start, i: F.struct(
                    F.get(tokens_sorted, start).alias("term"), (F.get(starts, i + 1) - start).alias("tf")
                ),
            ).alias("counts"),
        )
        .select(key, F.inline_outer("counts"))
        .where(F.col("term").isNotNull())
    )


def vocabulary(counts: DataFrame, documents: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """Terms found in at least ``min_df`` texts and at most the share ``max_df`` of them: ``term, tf, df, m``."""
    m = documents.agg(F.count("*")).scalar()
    return (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
        .withColumn("m", m)
        .where((F.col("df") >= min_df) & (F.col("df") <= F.col("m") * max_df))
    )


def idf_weights(vocab: DataFrame, min_doc_freq: int = MIN_DF) -> DataFrame:
    """``(term, df, idf)`` with ln((m + 1) / (df + 1)), and 0 below ``min_doc_freq`` texts."""
    weight = F.when(F.col("df") >= min_doc_freq, F.log((F.col("m") + 1) / (F.col("df") + 1))).otherwise(0.0)
    return vocab.select("term", "df", weight.alias("idf"))


def tfidf(counts: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """``(key, term, tfidf)``. Weights have one row per term; the planner broadcasts them by size or splits a hot term."""
    return counts.join(weights, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("tfidf"))


def lexicon_polarity(df: DataFrame, lexicon: DataFrame, key: str, words: str = "words") -> DataFrame:
    """Mean polarity of the lexicon words in each text, 0.0 without any: ``(key, polarity)``.

    ``lexicon`` is ``(word, polarity)`` with a word at most once. Each task reduces its texts to one
    row each before the shuffle; the join is left to the planner, which broadcasts by size.
    """
    return (
        df.select(key, F.explode_outer(words).alias("word"))
        .join(lexicon, "word", "left")
        .groupBy(key)
        .agg(F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("polarity"))
    )


def row_polarity(words: Column, lexicon: list[tuple[str, float]]) -> Column:
    """``lexicon_polarity`` of a token list against a lexicon of plain values, without leaving the row.

    Words of equal polarity are one set, which is looked up by hash.
    """
    sets: dict[float, list[str]] = {}
    for word, polarity in lexicon:
        sets.setdefault(polarity, []).append(word)

    def score(word: Column) -> Column:
        found = F.lit(None).cast("double")
        for polarity, members in sets.items():
            found = F.when(word.isin(members), F.lit(float(polarity))).otherwise(found)
        return found

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    scores = F.filter(F.transform(words, score), lambda x: x.isNotNull())
    add = lambda done, x: F.struct((done["sum"] + x).alias("sum"), (done["n"] + 1).alias("n"))
    return F.aggregate(scores, start, add, lambda done: F.when(done["n"] > 0, done["sum"] / done["n"]).otherwise(0.0))


def feature_table(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Cleaned text with polarity, length and word count, next to the class.

    A word that the lexicon repeats has the mean of its polarities. With a lexicon of at most ``IN_ROW`` words the polarity is found within the row, and the texts are neither shuffled nor
    read again. A longer one is joined by word, and the cleaned texts, written once, by key.
    """
    cleaned = df.select(key, clean_text(F.col(text)).alias("reviews"), "sentiment")
    words = tokens(F.col("reviews"))
    # One polarity per word, so that both ways agree on a lexicon that repeats one.
    lexicon = lexicon.groupBy("word").agg(F.avg("polarity").alias("polarity"))
    known = lexicon.limit(IN_ROW + 1).collect()
    if len(known) <= IN_ROW:
        scored = cleaned.withColumn("polarity", row_polarity(words, [tuple(r) for r in known if r["polarity"] is not None]))
    else:
        cleaned = stored(cleaned, "cleaned-texts")
        scored = cleaned.join(lexicon_polarity(cleaned.select(key, words.alias("words")), lexicon, key), key)
    return scored.select(
        key,
        "reviews",
        "polarity",
        review_len(F.col("reviews")).alias("review_len"),
        word_count(F.col("reviews")).alias("word_count"),
        "sentiment",
    )

