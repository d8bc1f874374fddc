"""The text and label functions under a name for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from opinara.functions.text import NUMBER_WORDS, PUNCTUATION, SPANS


def _literal(pattern: str) -> str:
    return "r'" + pattern + "'"


def register_sql_functions(spark: SparkSession) -> None:
    """Creates the temporary functions ``clean_text(text)`` and ``sentiment_label(code)``."""
    body = "lower(coalesce(t, 'None'))"
    for pattern in (*SPANS, PUNCTUATION, NUMBER_WORDS):
        body = f"regexp_replace({body}, {_literal(pattern)}, '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION clean_text(t STRING) RETURNS STRING RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION sentiment_label(code INT) RETURNS STRING "
        "RETURN CASE code WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' ELSE 'Positive' END"
    )
