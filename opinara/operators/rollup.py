"""Counts kept up as results arrive, for dashboards that would else scan all history.

A batch of results is reduced to one row per day, product and category before it is stored, and stored batches are
reduced again as they are put together. Counts, first titles and first times all combine, so whatever has been put together, the
answer is that of a scan. A time range that begins within a day takes that day from the results themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.labels import category_of
from opinara.operators.aggregates import COUNTERS, product_title
from opinara.operators.filters import range_start
from opinara.sources.sinks import BatchSink, read_tiers, tiered_batches

DAY, KEYS = "day", ["day", "asin", "category"]


def partial_counts(df: DataFrame, ts: str = "review_ts", title: str = "title", summary: str | None = None) -> DataFrame:
    """``day, asin, category, n, first_seen, title``: events, and time and title of the first one; unknown values are groups as well.

    On equal times the alphabetically first title wins, as in a scan.
    """
    named = product_title(title, summary)
    events = df.select(F.to_date(ts).alias(DAY), "asin", category_of(df).alias("category"), F.col(ts).alias("ts"), named.alias("title"))
    return events.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.min_by("title", F.struct("ts", "title")).alias("title")
    )


def combined(partials: DataFrame) -> DataFrame:
    """Partial counts of the same day, product and category as one row; rows of a day stand together, so that a range reads few of them."""
    rows = partials.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.min_by("title", F.struct("first_seen", "title")).alias("title")
    )
    return rows.repartitionByRange(DAY, "asin").sortWithinPartitions(DAY, "asin")


def rollup_sink(path: str, every: int = 10, **columns) -> BatchSink:
    """Sink for ``foreachBatch`` that stores a batch's partial counts; ``columns`` goes to ``partial_counts``."""
    write = tiered_batches(path, every, combine=combined)
    return lambda batch, batch_id: write(partial_counts(batch, **columns), batch_id)


def read_rollup(spark: SparkSession, path: str, every: int = 10) -> DataFrame:
    """The stored partial counts; a day, product and category may have several rows, which add up."""
    return read_tiers(spark, path, every)


def _counts(n: str = "n") -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("category") == c, F.col(n))), F.lit(0)).alias(c) for c in COUNTERS]


def rolled_counters(rollup: DataFrame) -> DataFrame:
    """``product_counters`` from partial counts."""
    known = rollup.where("category IS NOT NULL AND asin IS NOT NULL AND asin <> ''")
    return known.groupBy("asin").agg(
        *_counts(), F.min_by("title", F.struct("first_seen", "title")).alias("title"), F.min("first_seen").alias("first_seen")
    )


def rolled_stats(
    rollup: DataFrame,
    results: DataFrame,
    as_of: Column,
    product: str | None = None,
    time_range: str | None = None,
    sentiment: str | None = None,
    ts: str = "review_ts",
) -> DataFrame:
    """``sentiment_stats`` of the results that the dashboard's conditions leave, in one row.

    Whole days come from the partial counts. Of ``results`` only the day is read in which a time range begins, and none without a
    range. A reviewer is no part of the counts and needs the scan.
    """
    start = range_start(time_range, as_of)
    if start is not None:
        on_edge = results.where((F.col(ts) >= start) & (F.to_date(ts) == F.to_date(start)))
        edge = on_edge.select("asin", category_of(results).alias("category"), F.lit(1).cast("long").alias("n"))
        rollup = rollup.where(F.col(DAY) > F.to_date(start)).select("asin", "category", "n").unionByName(edge)
    if product not in (None, "all"):
        rollup = rollup.where(F.col("asin") == product)
    if sentiment not in (None, "all"):
        rollup = rollup.where(F.col("category") == sentiment.lower())
    return rollup.agg(*_counts(), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
