"""Multinomial naive Bayes on TF-IDF weights, with the model as tables.

Training is two aggregates and scoring one join, so neither the vocabulary nor the weights ever are on the driver, and
the vocabulary has no bound. The model is that of the pipeline with the same candidate: terms and weights are
those its feature stages and its classifier would fit on a training part with that many copies of each row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators.features import MAX_DF, MIN_DF, filtered_tokens, term_counts
from opinara.operators.sampling import copies_of, hash_split
from opinara.schema import CLASS_LABELS
from opinara.workspace import stored

#: Fixed value: the count that smoothing adds to each term and class.
SMOOTHING = 1.0
CLASSES = tuple(CLASS_LABELS)
#: Terms of a large model that are broadcast, the most frequent ones; the others are joined.
FREQUENT = 50_000


@dataclass
class BayesTables:
    """``terms``: (term, df, idf, w0, w1, w2), a row per term; ``classes``: (sentiment, prior, norm), a row per class."""

    terms: DataFrame
    classes: DataFrame

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.classes.coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BayesTables:
        return BayesTables(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/classes"))


def _of_class(code: int, value: Column) -> Column:
    return F.sum(F.when(F.col("sentiment") == code, value).otherwise(0))


def train_bayes(train: DataFrame, key: str, words: str = "words", min_df: int = MIN_DF, max_df: float = MAX_DF) -> BayesTables:
    """The model of training rows: ``key``, ``words`` (tokens without stop words), ``sentiment`` and ``copies``, how often each row counts.

    Texts are tokenised once, whatever their copies; equal tokens are counted within the row. A class without rows has
    no prior and is never chosen. Without any row every text is scored null.
    """
    rows = train.where(F.col("sentiment").isin(*CLASSES) & (F.col("copies") > 0))
    row = F.struct(F.col(key).alias("key"), "sentiment", "copies").alias("row")
    counts = term_counts(rows.select(row, words), "row", words).select("row.sentiment", "row.copies", "term", "tf")
    seen = [_of_class(c, F.col("copies") * F.col("tf")).alias(f"s{c}") for c in CLASSES]
    by_term = stored(counts.groupBy("term").agg(F.sum("copies").alias("df"), *seen).where(F.col("df") >= min_df), "term-classes")
    sizes = stored(rows.groupBy("sentiment").agg(F.sum("copies").alias("n")), "class-sizes")
    # One row per class from here on: its domain has three members.
    m = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    idf = F.log((F.lit(m) + 1) / (F.col("df") + 1))
    kept = by_term.where(F.col("df") <= max_df * F.lit(m)).withColumn("idf", idf)
    weights = [F.log(SMOOTHING + F.col("idf") * F.col(f"s{c}")).alias(f"w{c}") for c in CLASSES]
    terms = stored(kept.select("term", "df", "idf", *weights, *[f"s{c}" for c in CLASSES]), "bayes-terms")
    totals = terms.agg(F.count(F.lit(1)).alias("terms"), *[F.coalesce(F.sum(F.col("idf") * F.col(f"s{c}")), F.lit(0.0)).alias(f"s{c}") for c in CLASSES]).first()
    n = {r["sentiment"]: r["n"] for r in sizes.collect()}
    prior = lambda c: F.log(F.lit(n[c]) + SMOOTHING) - F.log(F.lit(m) + SMOOTHING * len(n))
    norm = lambda c: F.log(F.lit(totals[f"s{c}"]) + SMOOTHING * totals["terms"])
    one = train.sparkSession.range(1)
    made = [F.struct(F.lit(c).alias("sentiment"), prior(c).alias("prior"), norm(c).alias("norm")) for c in CLASSES if c in n]
    empty = F.array().cast("array<struct<sentiment: int, prior: double, norm: double>>")
    classes = one.select(F.inline(F.array(*made) if made else empty))
    return BayesTables(terms.select("term", "df", "idf", *[f"w{c}" for c in CLASSES]), classes)


def balanced_training(df: DataFrame, key: str, text: str = "reviews") -> DataFrame:
    """The training part with its tokens, and as ``copies`` how often each row comes to balance the classes."""
    train = hash_split(df, key).where("split = 'train'").drop("split")
    return filtered_tokens(copies_of(train, key), text).select(key, "words", "sentiment", "copies")


def _known(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """``counts`` of the terms of a model, with what the model has of each.

    Most of what texts hold are a large model's most frequent terms. These, ``FREQUENT`` at most, are broadcast, so that their rows
    become one row of sums per text before any shuffle; only rarer terms are joined by a shuffle. A smaller model is the planner's choice.
    """
    cut = terms.select("df").orderBy(F.desc("df")).offset(FREQUENT).first()
    if cut is None:
        return counts.join(terms, "term")
    frequent = F.broadcast(terms.where(F.col("df") > cut["df"]))
    rare = counts.join(frequent.select("term"), "term", "left_anti").join(terms.where(F.col("df") <= cut["df"]), "term")
    return counts.join(frequent, "term").unionByName(rare)


def score_bayes(texts: DataFrame, model: BayesTables, key: str, words: str = "words") -> DataFrame:
    """``(key, sentiment)`` for each text of ``(key, words)``; the first of equally likely classes.

    A large model's frequent terms are broadcast, its others joined by merging. Each text is reduced to one row of sums.
    A text without known terms gets the likeliest class.
    """
    counts = term_counts(texts.select(F.struct(F.col(key).alias("key")).alias("row"), words), "row", words).select(F.col("row.key").alias("key"), "term", "tf")
    known = _known(counts, model.terms).withColumn("v", F.col("tf") * F.col("idf"))
    sums = known.groupBy("key").agg(F.sum("v").alias("v"), *[F.sum(F.col("v") * F.col(f"w{c}")).alias(f"a{c}") for c in CLASSES])
    classes = {r["sentiment"]: r for r in model.classes.collect()}
    met = texts.select(F.col(key).alias("__key")).join(sums, F.col("__key").eqNullSafe(F.col("key")), "left")
    zero = F.lit(0.0)
    score = {c: F.lit(r["prior"]) + F.coalesce(f"a{c}", zero) - F.coalesce("v", zero) * r["norm"] for c, r in classes.items()}
    best = F.greatest(*score.values(), F.lit(float("-inf"))) if score else F.lit(None).cast("double")
    chosen = F.coalesce(*[F.when(score[c] == best, F.lit(c)) for c in CLASSES if c in score], F.lit(None).cast("int"))
    return met.select(F.col("__key").alias(key), chosen.alias("sentiment"))
