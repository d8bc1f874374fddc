"""Scoring reviews as they arrive, with the same text preparation as in training."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.labels import label_from_rating, sentiment_label
from opinara.functions.text import clean_text, concat_review
from opinara.operators.normalise import fill_empty, fill_missing, stamp_processed
from opinara.sources.readers import parse_json
from opinara.schema import RAW_RECORD_SCHEMA, STREAM_SCHEMA

# Fields of a scored record that come from the review.
PASSTHROUGH = ["reviewerID", "asin", "reviewerName", "reviewText", "overall", "summary", "reviewTime"]


def collected_to_stream(raw: DataFrame) -> DataFrame:
    """Collected records under the field names the scoring stream reads; a date that can't be read or told in 32 bits gives null."""
    return raw.select(
        F.lit(None).cast("string").alias("reviewerID"),
        "asin",
        F.col("reviewer_name").alias("reviewerName"),
        F.array("helpful_votes", "total_votes").alias("helpful"),
        "reviewText",
        F.col("overall").cast("float").alias("overall"),
        F.col("title").alias("summary"),
        F.unix_timestamp(F.col("date").try_cast("date").cast("timestamp")).try_cast("int").alias("unixReviewTime"),
        F.col("date").alias("reviewTime"),
    )


def records(stream: DataFrame, collected: bool = False) -> DataFrame:
    """Records in the JSON ``value`` of a topic; ``collected`` for those under the collector's names."""
    if collected:
        return collected_to_stream(parse_json(stream, RAW_RECORD_SCHEMA))
    return parse_json(stream, STREAM_SCHEMA)


def prepare_training(df: DataFrame, text: str = "reviewText", summary: str = "summary") -> DataFrame:
    """Adds cleaned ``reviews`` and ``sentiment``; a missing text reads "Missing", no summary drops the row."""
    joined = fill_missing(df, [text]).withColumn("reviews", concat_review(F.col(text), F.col(summary)))
    return joined.where(F.col("reviews").isNotNull()).select(
        *df.columns, clean_text(F.col("reviews")).alias("reviews"), label_from_rating(F.col("overall")).alias("sentiment")
    )


def prepare_scoring(df: DataFrame, text: str = "reviewText", summary: str = "summary") -> DataFrame:
    """Adds cleaned ``reviews`` to the records that have a text; a missing summary reads empty."""
    filled = fill_empty(df.where(F.col(text).isNotNull()), [text, summary])
    return filled.withColumn("reviews", clean_text(concat_review(F.col(text), F.col(summary))))


def scored(
    prepared: DataFrame, model: Model, keep: list[str] | None = None, as_of: Column | None = None, strict: bool = False
) -> DataFrame:
    """Scored records: the kept fields, class code, its label and the time of prediction."""
    predicted = model.transform(prepared).select(
        *(PASSTHROUGH if keep is None else keep),
        F.col("prediction").cast("int").alias("sentiment"),
        sentiment_label(F.col("prediction"), strict).alias("sentiment_label"),
    )
    return stamp_processed(predicted, as_of, "prediction_time")


def score_stream(stream: DataFrame, model: Model, collected: bool = False) -> DataFrame:
    """The scoring job, from JSON values to scored records."""
    return scored(prepare_scoring(records(stream, collected)), model)
