"""Top-k reports, feeds and latest-per-key. Every order ends in a full tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.labels import integer_percent
from opinara.operators.aggregates import product_counts, product_title, total_of_counts


def rank_products(counters: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` products with most events and their share of positive ones."""
    total = total_of_counts()
    return (
        counters.select("*", total.alias("total"), integer_percent(F.col("positive"), total).alias("positive_percent"))
        .orderBy(F.desc("total"), "asin")
        .limit(k)
    )


def top_products(df: DataFrame, titles: DataFrame | None = None, k: int = 5, ts: str = "review_ts") -> DataFrame:
    """Top products by number of events, with title of the first event and positive percentage.

    Counting needs two columns and combines in hash maps; titles are looked up only for the ``k``
    winners. The winners are the broadcast side: at most ``k`` rows. ``titles`` may bring the rows
    with ``asin``, ``title`` and time when ``df`` carries no title.
    """
    best = rank_products(product_counts(df), k)
    named = product_title()
    first_titles = (
        (df if titles is None else titles)
        .join(F.broadcast(best.select("asin")), "asin", "left_semi")
        .groupBy("asin")
        .agg(F.min_by(named, F.struct(F.col(ts), named)).alias("title"))
    )
    return (
        best.join(first_titles, "asin", "left")
        .select("asin", F.coalesce("title", F.concat(F.lit("Product "), "asin")).alias("title"), "total", "positive_percent")
        .orderBy(F.desc("total"), "asin")
        .limit(k)
    )


def latest(df: DataFrame, n: int = 100, ts: str = "review_ts", tie_break: list[str] | None = None) -> DataFrame:
    """The ``n`` newest rows; each task keeps its own best ``n`` before they meet."""
    ties = [c for c in df.columns if c != ts] if tie_break is None else tie_break
    return df.orderBy(F.desc(ts), *ties).limit(n)


def limit_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows per group.

    Spark cuts each task's groups to ``n`` before the shuffle, up to its own bound for ``n``. Beyond that the rows
    of a group are first ranked by the task they come from, so that no task gets a hot group whole
    and only the best ``n`` of each meet.
    """
    bound = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > bound:
        parts = df.withColumn("_part", F.spark_partition_id())
        df = _cut(parts, [*keys, "_part"], order, n).drop("_part")
    return _cut(df, keys, order, n)


def _cut(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= n).drop("_rank")


def dedup_latest(df: DataFrame, keys: list[str], ts: str = "scrape_ts", tie_break: list[str] | None = None) -> DataFrame:
    """The newest record per key, for feeds that deliver a record again on every scan."""
    ties = [c for c in df.columns if c not in (*keys, ts)] if tie_break is None else tie_break
    return limit_per_group(df, keys, [F.desc(ts), *[F.col(c) for c in ties]], 1)
