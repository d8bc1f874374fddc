"""Counts, means and time lines. All aggregates combine on the map side, so a hot product is no hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.labels import category_of, integer_percent
from opinara.schema import CATEGORIES, CLASS_LABELS
from opinara.workspace import stored

COUNTERS = ("positive", "neutral", "negative")


def category_counts(category: Column) -> list[Column]:
    """One conditional count per category, all in the same pass."""
    return [F.count_if(category == name).alias(name) for name in COUNTERS]


def total_of_counts() -> Column:
    return F.col("positive") + F.col("neutral") + F.col("negative")


def class_distribution(df: DataFrame, column: str = "sentiment") -> DataFrame:
    """Rows per class, in class order."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def class_imbalance(df: DataFrame, column: str = "sentiment") -> DataFrame:
    """Per class present: its count, the smallest and largest count, and largest / own.

    Counting into one row first needs neither a window over all classes nor a join.
    """
    names = {code: f"n_{code}" for code in CLASS_LABELS}
    one_row = df.agg(*[F.count_if(F.col(column) == code).alias(n) for code, n in names.items()])
    present = F.filter(
        F.array(*[F.struct(F.lit(c).alias(column), F.col(n).alias("n")) for c, n in names.items()]),
        lambda s: s["n"] > 0,
    )
    counts = F.transform(F.col("present"), lambda s: s["n"])
    return (
        one_row.select(present.alias("present"))
        .select(F.explode("present").alias("s"), F.array_min(counts).alias("min_n"), F.array_max(counts).alias("max_n"))
        .select(f"s.{column}", "s.n", "min_n", "max_n", (F.col("max_n") / F.col("s.n")).alias("ratio"))
    )


def sentiment_stats(df: DataFrame, sentiment: str = "sentiment", label: str = "sentiment_label") -> DataFrame:
    """Positive, negative, neutral and total in one pass over the rows."""
    category = category_of(df, sentiment, label)
    return df.agg(*category_counts(category), F.count("*").alias("total"))


def sentiment_percent(stats: DataFrame) -> DataFrame:
    """Adds each category's whole percentage of the total."""
    return stats.select(
        "*", *[integer_percent(F.col(c), F.col("total")).alias(f"{c}_percent") for c in COUNTERS]
    )


def product_title(title: str = "title", summary: str | None = None) -> Column:
    """Title, else summary, else a name made from the product id."""
    choices = [F.nullif(F.col(c), F.lit("")) for c in (title, summary) if c]
    return F.coalesce(*choices, F.concat(F.lit("Product "), F.col("asin")))


def known_events(df: DataFrame, sentiment: str = "sentiment", label: str = "sentiment_label") -> DataFrame:
    """Rows with a product and a known category, which is added as ``category``."""
    return df.withColumn("category", category_of(df, sentiment, label)).where(
        "category IS NOT NULL AND asin IS NOT NULL AND asin <> ''"
    )


def product_counts(df: DataFrame) -> DataFrame:
    """Per product: counts by category, for products with any event of a known category."""
    counted = df.where("asin <> ''").groupBy("asin").agg(*category_counts(category_of(df)))
    return counted.where(total_of_counts() > 0)


def product_counters(df: DataFrame, ts: str = "review_ts", title: str = "title", summary: str | None = None) -> DataFrame:
    """Per product: counts by category, and title and time of its first event.

    On equal times the alphabetically first title wins, so the result does not depend on arrival.
    """
    named = product_title(title, summary)
    return (
        known_events(df)
        .groupBy("asin")
        .agg(
            *category_counts(F.col("category")),
            F.min_by(named, F.struct(F.col(ts), named)).alias("title"),
            F.min(ts).alias("first_seen"),
        )
    )


def mask_categories(counters: DataFrame, selected: str = "all") -> DataFrame:
    """Counts of categories other than the selected one become 0; the product stays."""
    shown = [
        F.when(F.lit(selected).isin("all", c), F.col(c)).otherwise(F.lit(0).cast("bigint")).alias(c) for c in COUNTERS
    ]
    return counters.select(*[c for c in counters.columns if c not in COUNTERS], *shown)


def product_summary(df: DataFrame) -> DataFrame:
    """Per product: number of reviews, mean rating and category counts."""
    category = category_of(df, label=None)
    return df.groupBy("asin").agg(
        F.count("*").alias("total_reviews"),
        F.avg("overall").alias("average_rating"),
        *category_counts(category),
    )


def reviews_by_product(df: DataFrame) -> DataFrame:
    """Every review next to the summary of its product; reviews without a product id are a product of their own.

    The reviews of a product stay rows: packing them into one list per product would put a hot
    product into one task. The summaries are a table of their own: joined from the aggregate's partitions, a hot
    product could not be split by its size, as adaptive execution does with this join.
    """
    summary = stored(product_summary(df).withColumnRenamed("asin", "_asin"), "product-summary")
    return df.join(summary, F.col("asin").eqNullSafe(F.col("_asin"))).drop("_asin")


def average_rating(df: DataFrame) -> DataFrame:
    """Mean rating over all rows, 0 where there are none."""
    return df.agg(F.coalesce(F.avg("overall"), F.lit(0.0)).alias("average_rating"))


def daily_counts(df: DataFrame, as_of: Column, days: int = 7, ts: str = "review_ts") -> DataFrame:
    """Rows per day for the ``days`` days up to and including that of ``as_of``, empty days as 0.

    The calendar joins in as zero-valued rows of the same aggregate, which takes one shuffle.
    """
    last = F.to_date(as_of)
    first = F.date_sub(last, days)
    day = F.to_date(F.col(ts))
    spark = df.sparkSession
    calendar = spark.range(1, numPartitions=1).select(
        F.explode(F.sequence(first, last)).alias("day"), F.lit(0).cast("bigint").alias("n")
    )
    seen = df.where((F.col(ts) >= first) & (day <= last)).select(day.alias("day"), F.lit(1).cast("bigint").alias("n"))
    return seen.unionByName(calendar).groupBy("day").agg(F.sum("n").alias("n")).orderBy("day")


def timeline_points(df: DataFrame, ts: str = "review_ts") -> DataFrame:
    """One point per event: its time, product, category and the value 1."""
    category = category_of(df)
    points = df.select(
        F.col(ts).alias("x"),
        F.lit(1).alias("y"),
        F.coalesce(F.nullif(F.col("asin"), F.lit("")), F.lit("unknown")).alias("asin"),
        category.alias("category"),
    )
    return points.where(F.col("category").isNotNull())


def hourly_timeline(points: DataFrame) -> DataFrame:
    """Points per hour and category."""
    return points.groupBy(F.date_trunc("hour", "x").alias("hour"), "category").agg(F.sum("y").alias("n"))


def product_options(df: DataFrame, ts: str = "review_ts") -> DataFrame:
    """Products to choose from, labelled ``id: first title``, in label order."""
    named = product_title()
    return (
        df.where("asin IS NOT NULL AND asin <> ''")
        .groupBy("asin")
        .agg(F.min_by(named, F.struct(F.col(ts), named)).alias("title"))
        .select(F.col("asin").alias("value"), F.concat_ws(": ", "asin", "title").alias("label"))
        .orderBy("label", "value")
    )


def union_classes(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
