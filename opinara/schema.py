"""Record shapes and the sentiment class domain."""

from __future__ import annotations

from pyspark.sql import types as T

# The three sentiment classes, code and label.
NEGATIVE, NEUTRAL, POSITIVE = 0, 1, 2
CLASS_LABELS = {NEGATIVE: "Negative", NEUTRAL: "Neutral", POSITIVE: "Positive"}
CATEGORIES = {POSITIVE: "positive", NEUTRAL: "neutral", NEGATIVE: "negative"}

# One review, the shape every operator works on.
REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("reviewer_id", T.StringType()),
        T.StructField("reviewer_name", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("review_text", T.StringType()),
        T.StructField("overall", T.DoubleType()),
        T.StructField("review_ts", T.TimestampType()),
        T.StructField("helpful_votes", T.IntegerType()),
        T.StructField("total_votes", T.IntegerType()),
        T.StructField("scrape_ts", T.TimestampType()),
    ]
)

SCORED_SCHEMA = T.StructType(
    REVIEW_SCHEMA.fields
    + [
        T.StructField("sentiment", T.IntegerType()),
        T.StructField("sentiment_label", T.StringType()),
        T.StructField("prediction_ts", T.TimestampType()),
    ]
)

#: Stored results have a folder per period of this time, named by this pattern; names sort as the periods do.
RESULT_TIME, PERIOD = "review_ts", "yyyy-MM"

# Field names of the training file (JSON lines).
TRAINING_SCHEMA = T.StructType(
    [
        T.StructField("reviewText", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("overall", T.DoubleType()),
    ]
)

# Field names of a collected record on the raw topic.
RAW_RECORD_SCHEMA = T.StructType(
    [
        T.StructField("reviewer_name", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("review_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("overall", T.DoubleType()),
        T.StructField("reviewText", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("helpful_votes", T.IntegerType()),
        T.StructField("total_votes", T.IntegerType()),
        T.StructField("scrape_time", T.StringType()),
    ]
)

# Field names the scoring stream accepts.
STREAM_SCHEMA = T.StructType(
    [
        T.StructField("reviewerID", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("reviewerName", T.StringType()),
        T.StructField("helpful", T.ArrayType(T.IntegerType())),
        T.StructField("reviewText", T.StringType()),
        T.StructField("overall", T.FloatType()),
        T.StructField("summary", T.StringType()),
        T.StructField("unixReviewTime", T.IntegerType()),
        T.StructField("reviewTime", T.StringType()),
    ]
)

# Column order of the CSV export.
EXPORT_COLUMNS = [
    "reviewerID",
    "asin",
    "reviewer_name",
    "title",
    "overall",
    "reviewText",
    "date",
    "helpful_votes",
    "total_votes",
    "scrape_time",
]
