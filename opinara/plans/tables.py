"""Review-shaped views over the test tables, as DataFrames and as SQL.

``reviews``: one row per line item, without text. ``documents``: one row per document, with text.
``events``: the stream input. Dimensions join by outer join on their unique key, so a query that
shows none of their columns leaves the join out and gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.labels import label_from_rating, sentiment_label
from opinara.sources.readers import spread

#: Labels that are broadcast, at most: two numbers each and their key, some 100 MB. More are joined to the texts by a shuffle of both.
LABELS = 2_000_000

REVIEWS_SQL = """rv0 AS (
  SELECT l.l_orderkey || '-' || l.l_linenumber AS review_id, 'P' || l.l_partkey AS asin,
         'C' || o.o_custkey AS reviewer_id, c.c_name AS reviewer_name, p.p_name AS title,
         CAST(1 + l.l_quantity % 5 AS DOUBLE) AS overall, l.l_shipdate AS review_ts,
         l.l_linenumber AS helpful_votes, l.l_suppkey AS ord_hint
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN part p ON l.l_partkey = p.p_partkey),
rv AS (
  SELECT *, CASE WHEN overall = 3 THEN 1 WHEN overall IN (1, 2) THEN 0 ELSE 2 END AS sentiment,
         CASE WHEN overall = 3 THEN 'Neutral' WHEN overall IN (1, 2) THEN 'Negative' ELSE 'Positive' END AS sentiment_label,
         CASE WHEN overall = 3 THEN 'neutral' WHEN overall IN (1, 2) THEN 'negative' ELSE 'positive' END AS category
  FROM rv0)"""

DOCUMENTS_SQL = """rd AS (
  SELECT d.doc_id, d.text AS review_text, d.source AS asin, d.lang,
         CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 0 THEN CAST(1 + d.doc_id % 2 AS DOUBLE)
              WHEN l.toxic = 1 THEN 3.0 ELSE CAST(4 + d.doc_id % 2 AS DOUBLE) END AS overall,
         CASE WHEN l.quality = 0 AND l.toxic = 1 THEN NULL ELSE d.text END AS kept_text,
         CASE WHEN strpos(d.text, chr(10)) > 0 THEN split_part(d.text, chr(10), 1) END AS summary
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

EVENTS_SQL = """ev AS (
  SELECT event_id, ts, 'U' || user_id AS asin, props,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive'
              WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS category
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_reviewer(facts: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds reviewer id and name to review facts."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("reviewer_name")
    )
    return (
        facts.join(orders, "l_orderkey", "left")
        .join(customers, "o_custkey", "left")
        .withColumn("reviewer_id", F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
        .drop("o_custkey")
    )


def add_reviewer_id(facts: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds the reviewer id to review facts."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("reviewer_id")
    )
    return facts.join(orders, "l_orderkey", "left")


def add_title(facts: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds the product title to review facts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    return facts.join(parts, "l_partkey", "left")


def review_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews without reviewer and title, with the keys by which those join."""
    overall = (1 + F.col("l_quantity") % 5).cast("double")
    code = label_from_rating(F.col("overall"))
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            "l_orderkey",
            "l_partkey",
            F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("review_id"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("asin"),
            overall.alias("overall"),
            F.col("l_shipdate").alias("review_ts"),
            F.col("l_linenumber").alias("helpful_votes"),
            F.col("l_suppkey").alias("ord_hint"),
        )
        .withColumns({"sentiment": code, "sentiment_label": sentiment_label(code)})
    )


FACT_COLUMNS = ["review_id", "asin", "overall", "review_ts", "helpful_votes", "ord_hint", "sentiment", "sentiment_label"]


def facts_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_facts(spark, sf_dir).select(*FACT_COLUMNS)


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_title(review_facts(spark, sf_dir), spark, sf_dir).select(*FACT_COLUMNS, "title")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with all columns."""
    full = add_title(add_reviewer(review_facts(spark, sf_dir), spark, sf_dir), spark, sf_dir)
    return full.select(*FACT_COLUMNS, "reviewer_id", "reviewer_name", "title")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True class and a rule-made predicted class per review."""
    guess = (1 + (F.col("helpful_votes") + F.col("ord_hint")) % 5).cast("double")
    return facts_only(spark, sf_dir).select("sentiment", label_from_rating(guess).alias("prediction"))


PREDICTIONS_SQL = (
    REVIEWS_SQL
    + """,
pr AS (
  SELECT sentiment, CASE WHEN g = 3 THEN 1 WHEN g IN (1, 2) THEN 0 ELSE 2 END AS prediction
  FROM (SELECT sentiment, 1 + (helpful_votes + ord_hint) % 5 AS g FROM rv))"""
)


def rating_of(quality: Column, toxic: Column, doc_id: Column) -> Column:
    return (
        F.when(quality == 0, 1 + doc_id % 2)
        .when(quality.isNotNull() & F.coalesce(toxic == 1, F.lit(False)), 3)
        .when(quality.isNotNull(), 4 + doc_id % 2)
        .cast("double")
    )


def few_broadcast(rows: DataFrame) -> DataFrame:
    """Narrow rows to be joined to whole texts: broadcast if there are at most ``LABELS``, so that no text is shuffled; else as the planner likes."""
    return F.broadcast(rows) if rows.count() <= LABELS else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews: the whole text, a rating where there is a label.

    ``kept_text`` lacks the texts labelled both poor and toxic; ``summary`` is the first line of a
    text that has more than one.
    """
    text = F.col("text")
    labels = few_broadcast(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    withheld = F.coalesce((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit(False))
    return (
        spread(table(spark, sf_dir, "documents"))
        .join(labels, "doc_id", "left")
        .select(
            "doc_id",
            text.alias("review_text"),
            F.col("source").alias("asin"),
            "lang",
            rating_of(F.col("quality"), F.col("toxic"), F.col("doc_id")).alias("overall"),
            F.when(~withheld, text).alias("kept_text"),
            F.when(F.contains(text, F.lit("\n")), F.substring_index(text, "\n", 1)).alias("summary"),
        )
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts alone, which needs no labels."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("review_text")))


def event_category(event_type: Column) -> Column:
    return F.when(event_type.isin("purchase", "signup"), "positive").when(event_type == "error", "negative").otherwise("neutral")


def as_events(df: DataFrame) -> DataFrame:
    """Event rows as sentiment events, batch or stream; the time gets a zone, which watermarks need."""
    return df.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asin"),
        event_category(F.col("event_type")).alias("sentiment"),
        F.lit(None).cast("string").alias("sentiment_label"),
        "props",
    )
