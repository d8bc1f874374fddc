"""Queries of the dashboard: filters, counts, rankings, time lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions.labels import canonical_category, label_from_rating, sentiment_label
from opinara.operators import aggregates, filters, normalise, ranking
from opinara.plans import tables as t
from opinara.plans.registry import query

RV = "WITH " + t.REVIEWS_SQL + "\n"
RD = "WITH " + t.DOCUMENTS_SQL + "\n"

FACTS = "review_id, asin, overall, review_ts, helpful_votes, ord_hint, sentiment, sentiment_label"
ALL = FACTS + ", reviewer_id, reviewer_name, title"
_COUNTS = """count(*) FILTER (category = 'positive') AS positive, count(*) FILTER (category = 'neutral') AS neutral,
       count(*) FILTER (category = 'negative') AS negative"""
_FIRST_TITLE = "SELECT asin, title FROM (SELECT asin, title, row_number() OVER (PARTITION BY asin ORDER BY review_ts, title) AS k FROM rv) WHERE k = 1"


# Ranking


@query(
    "top_products",
    RV
    + f""", c AS (SELECT asin, {_COUNTS}, count(*) AS total FROM rv GROUP BY asin), f AS ({_FIRST_TITLE})
SELECT c.asin, f.title, c.total, CAST(round(c.positive / c.total * 100) AS BIGINT) AS positive_percent
FROM c JOIN f ON c.asin = f.asin ORDER BY c.total DESC, c.asin LIMIT 5""",
)
def top_products(spark, sf):
    return ranking.top_products(t.facts_only(spark, sf), titles=t.titled(spark, sf))


@query("latest_feed", RV + f"SELECT {ALL} FROM rv ORDER BY review_ts DESC, review_id, asin, overall, ord_hint LIMIT 100")
def latest_feed(spark, sf):
    newest = ranking.latest(t.review_facts(spark, sf), tie_break=["review_id", "asin", "overall", "ord_hint"])
    return t.add_title(t.add_reviewer(newest, spark, sf), spark, sf).select(*ALL.split(", "))


@query("reviews_limit", RV + f"SELECT {FACTS} FROM rv ORDER BY review_ts DESC, review_id, asin, overall, ord_hint LIMIT 20")
def reviews_limit(spark, sf):
    return ranking.latest(t.facts_only(spark, sf), 20, tie_break=["review_id", "asin", "overall", "ord_hint"])


@query(
    "limit_per_group",
    RV
    + f"""SELECT {FACTS} FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY review_ts DESC, review_id, overall, ord_hint) AS k
FROM rv) WHERE k <= 10""",
)
def limit_per_group(spark, sf):
    order = [F.desc("review_ts"), F.col("review_id"), F.col("overall"), F.col("ord_hint")]
    return ranking.limit_per_group(t.facts_only(spark, sf), ["asin"], order, 10)


@query(
    "dedup_latest",
    RV
    + f"""SELECT {FACTS} FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY review_ts DESC, asin, overall, ord_hint) AS k
FROM rv) WHERE k = 1""",
)
def dedup_latest(spark, sf):
    return ranking.dedup_latest(t.facts_only(spark, sf), ["review_id"], "review_ts", ["asin", "overall", "ord_hint"])


# Aggregates


@query("class_distribution", RD + """SELECT CASE WHEN overall = 3 THEN 1 WHEN overall IN (1, 2) THEN 0 ELSE 2 END AS sentiment, count(*) AS n
FROM rd GROUP BY 1 ORDER BY 1""")
def class_distribution(spark, sf):
    labelled = t.documents(spark, sf).select(label_from_rating(F.col("overall")).alias("sentiment"))
    return aggregates.class_distribution(labelled)


@query("class_imbalance", RD + """, c AS (
  SELECT CASE WHEN overall = 3 THEN 1 WHEN overall IN (1, 2) THEN 0 ELSE 2 END AS sentiment, count(*) AS n FROM rd GROUP BY 1)
SELECT sentiment, n, min(n) OVER () AS min_n, max(n) OVER () AS max_n, max(n) OVER () / n AS ratio FROM c""")
def class_imbalance(spark, sf):
    labelled = t.documents(spark, sf).select(label_from_rating(F.col("overall")).alias("sentiment"))
    return aggregates.class_imbalance(labelled)


@query("sentiment_stats", RV + f"SELECT {_COUNTS}, count(*) AS total FROM rv")
def sentiment_stats(spark, sf):
    return aggregates.sentiment_stats(t.facts_only(spark, sf))


@query(
    "sentiment_percent",
    RV
    + f""", s AS (SELECT {_COUNTS}, count(*) AS total FROM rv)
SELECT *, CAST(round(positive / total * 100) AS BIGINT) AS positive_percent, CAST(round(neutral / total * 100) AS BIGINT) AS neutral_percent,
       CAST(round(negative / total * 100) AS BIGINT) AS negative_percent FROM s""",
)
def sentiment_percent(spark, sf):
    return aggregates.sentiment_percent(aggregates.sentiment_stats(t.facts_only(spark, sf)))


_COUNTERS = f""", c AS (SELECT asin, {_COUNTS}, min(review_ts) AS first_seen FROM rv GROUP BY asin), f AS ({_FIRST_TITLE})
"""


@query("product_counters", RV + _COUNTERS + "SELECT c.*, f.title FROM c JOIN f ON c.asin = f.asin")
def product_counters(spark, sf):
    return aggregates.product_counters(t.titled(spark, sf))


@query(
    "product_counters_masked",
    RV
    + _COUNTERS
    + """SELECT c.asin, f.title, c.first_seen, CAST(0 AS BIGINT) AS positive, CAST(0 AS BIGINT) AS neutral, c.negative
FROM c JOIN f ON c.asin = f.asin""",
)
def product_counters_masked(spark, sf):
    return aggregates.mask_categories(aggregates.product_counters(t.titled(spark, sf)), "negative")


@query("product_summary", RV + f"SELECT asin, count(*) AS total_reviews, avg(overall) AS average_rating, {_COUNTS} FROM rv GROUP BY asin")
def product_summary(spark, sf):
    return aggregates.product_summary(t.facts_only(spark, sf))


@query(
    "reviews_by_product",
    RV
    + f""", sm AS (SELECT * REPLACE (CASE WHEN ord_hint % 10 = 0 THEN NULL WHEN ord_hint % 10 = 1 THEN '' ELSE asin END AS asin) FROM rv),
s AS (SELECT asin, count(*) AS total_reviews, avg(overall) AS average_rating, {_COUNTS} FROM sm GROUP BY asin)
SELECT sm.asin, review_id, overall, review_ts, total_reviews, average_rating, positive, neutral, negative FROM sm JOIN s ON sm.asin IS NOT DISTINCT FROM s.asin""",
)
def reviews_by_product(spark, sf):
    """Some reviews have no product id, some an empty one."""
    hint = F.col("ord_hint") % 10
    some = t.facts_only(spark, sf).withColumn("asin", F.when(hint == 1, "").when(hint != 0, F.col("asin")))
    return aggregates.reviews_by_product(some).select(
        "asin", "review_id", "overall", "review_ts", "total_reviews", "average_rating", "positive", "neutral", "negative"
    )


@query("average_rating", RV + "SELECT coalesce(avg(overall), 0.0) AS average_rating FROM rv")
def average_rating(spark, sf):
    return aggregates.average_rating(t.facts_only(spark, sf))


@query(
    "daily_counts_filled",
    RV
    + """, b AS (SELECT CAST(max(review_ts) AS DATE) AS last FROM rv),
cal AS (SELECT CAST(unnest(generate_series(last - INTERVAL 90 DAY, CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b),
n AS (SELECT CAST(review_ts AS DATE) AS day, count(*) AS n FROM rv GROUP BY 1)
SELECT cal.day, coalesce(n.n, 0) AS n FROM cal LEFT JOIN n ON cal.day = n.day ORDER BY 1""",
)
def daily_counts_filled(spark, sf):
    facts = t.facts_only(spark, sf)
    return aggregates.daily_counts(facts, filters.latest_time(facts), days=90)


@query("sentiment_timeline_points", RV + "SELECT review_ts AS x, 1 AS y, asin, category FROM rv")
def sentiment_timeline_points(spark, sf):
    return aggregates.timeline_points(t.facts_only(spark, sf))


@query("sentiment_timeline_hourly", "WITH " + t.EVENTS_SQL + "SELECT date_trunc('hour', ts) AS hour, category, count(*) AS n FROM ev GROUP BY 1, 2")
def sentiment_timeline_hourly(spark, sf):
    points = aggregates.timeline_points(t.as_events(t.table(spark, sf, "events")), "ts")
    return aggregates.hourly_timeline(points).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "category", "n")


@query(
    "top_products_masked",
    RV
    + f""", n AS (SELECT asin, count(*) AS total FROM rv WHERE category = 'positive' AND overall < 5 GROUP BY asin)
SELECT asin, total AS positive, CAST(0 AS BIGINT) AS neutral, CAST(0 AS BIGINT) AS negative, total FROM n ORDER BY total DESC, asin LIMIT 5""",
)
def top_products_masked(spark, sf):
    """Filter, then counts of the shown category only, then the five products with most of them."""
    shown = t.facts_only(spark, sf).where(F.col("overall") < 5)
    masked = aggregates.mask_categories(aggregates.product_counts(shown), "positive")
    return ranking.rank_products(masked).drop("positive_percent")


@query(
    "sentiment_timeline_filtered",
    RV
    + """SELECT date_trunc('hour', review_ts) AS hour, category, count(*) AS n FROM rv
WHERE sentiment = 0 AND review_ts >= (SELECT max(review_ts) FROM rv) - INTERVAL 90 DAY GROUP BY 1, 2""",
)
def sentiment_timeline_filtered(spark, sf):
    facts = t.facts_only(spark, sf)
    shown = filters.dashboard_filter(facts, time_range="90d", sentiment="negative", as_of=filters.latest_time(facts))
    return aggregates.hourly_timeline(aggregates.timeline_points(shown))


@query("product_options", RV + f", f AS ({_FIRST_TITLE}) SELECT asin AS value, asin || ': ' || title AS label FROM f ORDER BY label, value")
def product_options(spark, sf):
    return aggregates.product_options(t.titled(spark, sf))


@query("union_classes", RV + f"SELECT {FACTS} FROM rv WHERE sentiment = 0 UNION ALL SELECT {FACTS} FROM rv WHERE sentiment = 1 UNION ALL SELECT {FACTS} FROM rv WHERE sentiment = 2")
def union_classes(spark, sf):
    facts = t.facts_only(spark, sf)
    return aggregates.union_classes([facts.where(F.col("sentiment") == c) for c in (0, 1, 2)])


# Filters


@query("filter_text_present", RD + "SELECT doc_id, kept_text, overall FROM rd WHERE kept_text IS NOT NULL")
def filter_text_present(spark, sf):
    return t.documents(spark, sf).select("doc_id", "kept_text", "overall").where(filters.text_present("kept_text"))


@query("filter_product", RV + f"SELECT {FACTS} FROM rv WHERE asin = 'P7'")
def filter_product(spark, sf):
    return filters.dashboard_filter(t.facts_only(spark, sf), product="P7")


@query("filter_reviewer", RV + f"SELECT {FACTS}, reviewer_id FROM rv WHERE reviewer_id = 'C7'")
def filter_reviewer(spark, sf):
    facts = t.add_reviewer_id(t.review_facts(spark, sf), spark, sf)
    return filters.dashboard_filter(facts, reviewer="C7").select(*t.FACT_COLUMNS, "reviewer_id")


@query("find_review", RV + f"SELECT {FACTS} FROM rv WHERE review_id = '7-1'")
def find_review(spark, sf):
    from opinara.sources.readers import find_review as find

    return find(t.facts_only(spark, sf), "7-1")


@query("filter_time_range", RV + f"SELECT {FACTS} FROM rv WHERE review_ts >= (SELECT max(review_ts) FROM rv) - INTERVAL 30 DAY")
def filter_time_range(spark, sf):
    facts = t.facts_only(spark, sf)
    return filters.dashboard_filter(facts, time_range="last-30-days", as_of=filters.latest_time(facts))


@query(
    "filter_any_date",
    "WITH "
    + t.REVIEWS_SQL
    + f""", d AS (SELECT rv0.*, o.o_orderdate AS created_at FROM (SELECT *, CAST(split_part(review_id, '-', 1) AS BIGINT) AS k FROM rv) rv0
  LEFT JOIN orders o ON rv0.k = o.o_orderkey)
SELECT {FACTS}, created_at FROM d WHERE review_ts >= (SELECT max(review_ts) FROM rv) - INTERVAL 90 DAY
OR created_at >= (SELECT max(review_ts) FROM rv) - INTERVAL 90 DAY""",
)
def filter_any_date(spark, sf):
    facts = t.review_facts(spark, sf)
    orders = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("created_at"))
    dated = facts.join(orders, "l_orderkey", "left").select(*t.FACT_COLUMNS, "created_at")
    return filters.dashboard_filter(
        dated, time_range="90d", as_of=filters.latest_time(facts), ts_columns=("review_ts", "created_at")
    )


@query("filter_sentiment", RV + f"SELECT {FACTS} FROM rv WHERE sentiment = 0 OR lower(sentiment_label) = 'negative'")
def filter_sentiment(spark, sf):
    return filters.dashboard_filter(t.facts_only(spark, sf), sentiment="negative")


@query("filter_five_stars", RV + f"SELECT {FACTS} FROM rv WHERE overall >= 5")
def filter_five_stars(spark, sf):
    facts = t.facts_only(spark, sf)
    return filters.quick_filter(facts, "5-stars", filters.latest_time(facts))


@query("filter_recent", RV + f"SELECT {FACTS} FROM rv WHERE review_ts >= (SELECT max(review_ts) FROM rv) - INTERVAL 7 DAY")
def filter_recent(spark, sf):
    facts = t.facts_only(spark, sf)
    return filters.quick_filter(facts, "recent", filters.latest_time(facts))


@query("search_reviews", RD + "SELECT doc_id, review_text, lang FROM rd WHERE contains(lower(review_text), 'tion') OR contains(lower(asin), 'tion')")
def search_reviews(spark, sf):
    rows = t.table(spark, sf, "documents").select("doc_id", F.col("text").alias("review_text"), F.col("source").alias("reviewer_name"), "lang")
    return filters.search_reviews(rows, "TION").select("doc_id", "review_text", "lang")


@query("filter_asin_contains", RV + f"SELECT {FACTS} FROM rv WHERE contains(lower(asin), 'p19')")
def filter_asin_contains(spark, sf):
    return t.facts_only(spark, sf).where(filters.asin_contains("p19"))


@query(
    "dashboard_filter",
    RV
    + f"""SELECT {_COUNTS}, count(*) AS total FROM rv WHERE asin = 'P7' AND sentiment = 2
AND review_ts >= (SELECT max(review_ts) FROM rv) - INTERVAL 90 DAY""",
)
def dashboard_filter(spark, sf):
    facts = t.facts_only(spark, sf)
    found = filters.dashboard_filter(
        facts, product="P7", reviewer="all", time_range="last-90d", sentiment="positive", as_of=filters.latest_time(facts)
    )
    return aggregates.sentiment_stats(found)


# Records


_ALIASED = """, a AS (
  SELECT review_id, CASE WHEN overall > 3 THEN asin ELSE '' END AS asin, asin AS product_id,
         CASE WHEN overall = 5 THEN NULL ELSE title END AS product_title, title || '!' AS summary,
         CASE WHEN overall = 3 THEN 0.0 ELSE overall END AS rating, overall AS stars,
         CASE WHEN helpful_votes = 1 THEN NULL ELSE reviewer_name END AS reviewer_name,
         CASE WHEN overall = 1 THEN NULL ELSE CAST(CAST(review_ts AS DATE) AS VARCHAR) END AS review_time,
         CAST(helpful_votes AS VARCHAR) AS helpful_votes, sentiment, CASE WHEN overall = 2 THEN sentiment_label ELSE '' END AS sentiment_label
  FROM rv)
"""


@query(
    "normalise_review",
    RV
    + _ALIASED
    + """SELECT review_id, coalesce(nullif(asin, ''), nullif(product_id, ''), 'unknown') AS asin,
       coalesce(nullif(product_title, ''), nullif(summary, ''), '') AS title, '' AS reviewText,
       coalesce(nullif(reviewer_name, ''), 'Anonymous') AS reviewerName,
       coalesce(nullif(rating, 0), nullif(stars, 0), 0) AS overall, CAST(helpful_votes AS INTEGER) AS helpfulVotes,
       0 AS totalVotes, CAST(0 AS DOUBLE) AS confidence, coalesce(review_time, '2024-01-01') AS date, '2024-01-01' AS processedAt,
       coalesce(nullif(lower(sentiment_label), ''), CASE sentiment WHEN 2 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END) AS sentiment
FROM a""",
)
def normalise_review(spark, sf):
    overall, none = F.col("overall"), F.lit(None)
    raw = t.reviews(spark, sf).select(
        "review_id",
        F.when(overall > 3, F.col("asin")).otherwise("").alias("asin"),
        F.col("asin").alias("product_id"),
        F.when(overall == 5, none).otherwise(F.col("title")).alias("product_title"),
        F.concat("title", F.lit("!")).alias("summary"),
        F.when(overall == 3, 0.0).otherwise(overall).alias("rating"),
        overall.alias("stars"),
        F.when(F.col("helpful_votes") != 1, F.col("reviewer_name")).alias("reviewer_name"),
        F.when(overall != 1, F.date_format("review_ts", "yyyy-MM-dd")).alias("review_time"),
        F.col("helpful_votes").cast("string").alias("helpful_votes"),
        "sentiment",
        F.when(overall == 2, F.col("sentiment_label")).otherwise("").alias("sentiment_label"),
    )
    return normalise.normalise_review(raw, F.lit("2024-01-01"), keep=("review_id",))


@query("label_from_rating", RD + """SELECT doc_id, overall, CASE WHEN overall = 3 THEN 1 WHEN overall IN (1, 2) THEN 0 ELSE 2 END AS sentiment,
CASE WHEN overall IS NULL THEN NULL WHEN overall = 3 THEN 1 WHEN overall IN (1, 2) THEN 0 ELSE 2 END AS strict_sentiment FROM rd""")
def label_from_rating_query(spark, sf):
    rating = F.col("overall")
    return t.documents(spark, sf).select(
        "doc_id",
        "overall",
        label_from_rating(rating).alias("sentiment"),
        label_from_rating(rating, strict=True).alias("strict_sentiment"),
    )


@query("sentiment_label", RV + """SELECT review_id, ord_hint % 4 AS code, CASE ord_hint % 4 WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' ELSE 'Positive' END AS label,
CASE ord_hint % 4 WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END AS strict_label FROM rv""")
def sentiment_label_query(spark, sf):
    code = F.col("ord_hint") % 4
    return t.facts_only(spark, sf).select(
        "review_id", code.alias("code"), sentiment_label(code).alias("label"), sentiment_label(code, strict=True).alias("strict_label")
    )


@query(
    "canonical_category",
    RV
    + """, m AS (SELECT review_id, CASE helpful_votes WHEN 1 THEN CAST(sentiment AS VARCHAR) WHEN 2 THEN category WHEN 3 THEN NULL ELSE 'mixed' END AS s,
  CASE WHEN helpful_votes = 3 THEN sentiment_label END AS l, category AS c, helpful_votes AS h FROM rv)
SELECT review_id, s AS sentiment, l AS label, CASE WHEN h <= 3 THEN c END AS known, CASE WHEN h <= 3 THEN c ELSE 'neutral' END AS filled FROM m""",
)
def canonical_category_query(spark, sf):
    votes = F.col("helpful_votes")
    code = F.col("sentiment")
    mixed = t.facts_only(spark, sf).select(
        "review_id",
        F.when(votes == 1, code.cast("string"))
        .when(votes == 2, canonical_category(code))
        .when(votes != 3, "mixed")
        .alias("sentiment"),
        F.when(votes == 3, F.col("sentiment_label")).alias("label"),
    )
    return mixed.select(
        "*",
        canonical_category(F.col("sentiment"), F.col("label")).alias("known"),
        canonical_category(F.col("sentiment"), F.col("label"), unknown="neutral").alias("filled"),
    )


@query("stamp_processed", RV + "SELECT review_id, asin, sentiment, (SELECT max(review_ts) FROM rv) AS processed_at FROM rv")
def stamp_processed(spark, sf):
    facts = t.facts_only(spark, sf)
    return normalise.stamp_processed(facts.select("review_id", "asin", "sentiment"), filters.latest_time(facts))
