"""Edge rows, skew and invariants of the DataFrame operators."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opinara.operators import aggregates, extraction, filters, metrics, normalise, ranking, sampling
from opinara.plans import tables as t
from opinara.sources import readers, sinks
from opinara.workspace import new_folder, scratch_root

AS_OF = datetime(2024, 3, 10, 12)
SCHEMA = "review_id string, asin string, title string, overall double, review_ts timestamp, sentiment int, sentiment_label string"


def skewed_reviews(n=3000, seed=7):
    """Reviews of which one product holds a third."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        asin = "HOT" if rng.random() < 1 / 3 else f"P{rng.randrange(40)}"
        s = rng.choice([0, 1, 2, 2])
        ts = AS_OF - timedelta(minutes=rng.randrange(60 * 24 * 20))
        rows.append((f"r{i % 2500}", asin, rng.choice(["", None, "b", "a"]), float(rng.randrange(6)), ts, s, ["Negative", "Neutral", "Positive"][s]))
    return rows


@pytest.fixture(scope="module")
def rows():
    return skewed_reviews()


@pytest.fixture(scope="module")
def reviews(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def title_of(row):
    return row[2] or f"Product {row[1]}"


def test_product_counters_with_hot_product(reviews, rows):
    expected = defaultdict(Counter)
    first = {}
    for r in rows:
        expected[r[1]][r[5]] += 1
        first[r[1]] = min(first.get(r[1], (datetime.max, "")), (r[4], title_of(r)))
    got = {r["asin"]: r for r in aggregates.product_counters(reviews).collect()}
    assert got.keys() == expected.keys()
    for asin, r in got.items():
        assert (r["negative"], r["neutral"], r["positive"]) == tuple(expected[asin][i] for i in range(3))
        assert (r["first_seen"], r["title"]) == first[asin]
    assert sum(r["negative"] + r["neutral"] + r["positive"] for r in got.values()) == len(rows)


def test_top_products_with_hot_product(reviews, rows):
    totals = Counter(r[1] for r in rows)
    best = sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:5]
    got = ranking.top_products(reviews).collect()
    assert [(r["asin"], r["total"]) for r in got] == best
    assert got[0]["asin"] == "HOT"
    assert got[0]["title"] == min((r[4], title_of(r)) for r in rows if r[1] == "HOT")[1]


def test_top_products_ties_go_by_product(spark):
    rows = [(f"r{i}", asin, "t", 5.0, AS_OF, 2, "Positive") for i, asin in enumerate(["C", "A", "B", "A", "B", "C"])]
    got = ranking.top_products(spark.createDataFrame(rows, SCHEMA), k=2).collect()
    assert [(r["asin"], r["total"], r["positive_percent"]) for r in got] == [("A", 2, 100), ("B", 2, 100)]


def test_reviews_by_product_keeps_every_review(reviews, rows):
    joined = aggregates.reviews_by_product(reviews)
    assert joined.count() == len(rows)
    totals = Counter(r[1] for r in rows)
    assert {r["asin"]: r["total_reviews"] for r in joined.select("asin", "total_reviews").distinct().collect()} == totals


def test_dedup_latest_with_hot_key(spark, rows):
    hot = [("same", *r[1:]) for r in rows[:1000]] + rows
    got = ranking.dedup_latest(spark.createDataFrame(hot, SCHEMA), ["review_id"], "review_ts").collect()
    newest = {}
    for r in hot:
        newest[r[0]] = max(newest.get(r[0], datetime.min), r[4])
    assert {r["review_id"]: r["review_ts"] for r in got} == newest and len(got) == len(newest)


def test_limit_per_group_is_cut_before_the_shuffle(reviews):
    limited = ranking.limit_per_group(reviews, ["asin"], [F.desc("review_ts"), F.col("review_id")], 3)
    assert "WindowGroupLimit" in limited._jdf.queryExecution().executedPlan().toString()
    assert limited.groupBy("asin").count().agg(F.max("count")).first()[0] == 3


def test_latest_is_a_top_k(reviews, rows):
    newest = ranking.latest(reviews, 100)
    assert "TakeOrderedAndProject" in newest._jdf.queryExecution().executedPlan().toString()
    assert [r["review_ts"] for r in newest.collect()] == sorted((r[4] for r in rows), reverse=True)[:100]


def test_daily_counts_fill_and_drop(spark):
    times = [AS_OF, AS_OF - timedelta(days=2), AS_OF - timedelta(days=2), AS_OF - timedelta(days=4), AS_OF + timedelta(days=1)]
    df = spark.createDataFrame([(x,) for x in times], "review_ts timestamp")
    got = aggregates.daily_counts(df, F.lit(AS_OF), days=3).collect()
    assert [(str(r["day"]), r["n"]) for r in got] == [("2024-03-07", 0), ("2024-03-08", 2), ("2024-03-09", 0), ("2024-03-10", 1)]


def test_time_range_bound_is_kept_and_unknown_name_is_no_filter(spark):
    times = [AS_OF - timedelta(days=7), AS_OF - timedelta(days=7, seconds=1)]
    df = spark.createDataFrame([(x,) for x in times], "review_ts timestamp")
    assert filters.dashboard_filter(df, time_range="7d", as_of=F.lit(AS_OF)).count() == 1
    assert filters.dashboard_filter(df, time_range="all-time", as_of=F.lit(AS_OF)).count() == 2
    assert filters.dashboard_filter(df, time_range="whatever", as_of=F.lit(AS_OF)).count() == 2


def test_search_has_no_wildcards(spark):
    df = spark.createDataFrame([("it is 100% good", "Ann"), ("100 good", None), (None, "MR 100%")], "review_text string, reviewer_name string")
    assert filters.search_reviews(df, "100%").count() == 2
    assert filters.search_reviews(df, "").count() == 3


def test_asin_contains_drops_missing_ids(spark):
    df = spark.createDataFrame([("B0X",), (None,), ("",), ("A1",)], "asin string")
    assert df.where(filters.asin_contains("b0")).count() == 1
    assert df.where(filters.asin_contains("")).count() == 2


def test_class_filter_and_time_filter_both_apply(reviews, rows):
    found = filters.dashboard_filter(reviews, time_range="24h", sentiment="positive", as_of=F.lit(AS_OF))
    start = AS_OF - timedelta(days=1)
    stats = aggregates.sentiment_stats(found).first()
    expected = sum(r[5] == 2 and r[4] >= start for r in rows)
    assert (stats["positive"], stats["negative"], stats["neutral"], stats["total"]) == (expected, 0, 0, expected)


def test_normalise_review(spark):
    raw = spark.createDataFrame(
        [(0.0, 4.0, "", "sum", None, "Positive"), (2.0, None, "t", "s", 1, ""), (None, None, None, None, None, None)],
        "rating double, stars double, title string, summary string, sentiment int, sentiment_label string",
    )
    got = normalise.normalise_review(raw, F.lit("now")).collect()
    assert [(r["overall"], r["title"], r["sentiment"]) for r in got] == [(4.0, "sum", "positive"), (2.0, "t", "neutral"), (0.0, "", "")]
    assert {(r["asin"], r["reviewerName"], r["date"], r["helpfulVotes"]) for r in got} == {("unknown", "Anonymous", "now", 0)}


def test_confusion_cells_sum_to_rows_and_metrics_equal_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(3), rng.choice([0, 2, 2])) for _ in range(500)]
    counts = metrics.confusion_counts(spark.createDataFrame(pairs, "sentiment int, prediction int"))
    cells = {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion_matrix(counts).collect()}
    assert sum(cells.values()) == 500 and len(cells) == 9
    seen = Counter(pairs)
    assert all(cells[k] == seen[k] for k in cells)
    by_class = {r["class"]: r for r in metrics.class_metrics(counts).collect()}
    assert (by_class["Neutral"]["precision"], by_class["Neutral"]["f1"]) == (0.0, 0.0)
    assert by_class["Positive"]["recall"] == cells[2, 2] / sum(cells[2, j] for j in range(3))
    quality = metrics.accuracy_f1(counts).first()
    assert quality["accuracy"] == sum(a == b for a, b in pairs) / 500


def test_metrics_of_no_rows_are_zero(spark):
    counts = metrics.confusion_counts(spark.createDataFrame([], "sentiment int, prediction int"))
    assert metrics.accuracy_f1(counts).first().asDict() == {"accuracy": 0.0, "f1": 0.0}
    assert {r["specificity"] for r in metrics.class_specificity(counts).collect()} == {0.0}
    assert {r["value"] for r in metrics.model_statistics(counts).collect()} == {0.0}


def test_splits_are_disjoint_complete_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    split = {r["doc_id"]: r["split"] for r in sampling.hash_split(df, "doc_id").collect()}
    again = {r["doc_id"]: r["split"] for r in sampling.hash_split(df.repartition(7), "doc_id").collect()}
    assert split == again and len(split) == 5000
    share = Counter(split.values())
    assert 0.77 < share["train"] / 5000 < 0.83 and 0.08 < share["validation"] / 5000 < 0.12


def test_oversample_balances_and_keeps_every_row(spark):
    df = spark.createDataFrame([(i, 2 if i < 700 else (0 if i < 900 else 1)) for i in range(1000)], "k int, sentiment int")
    copies = sampling.oversample(df, "k")
    n = {r["sentiment"]: r["n"] for r in aggregates.class_distribution(copies).collect()}
    assert n[2] == 700 and abs(n[0] - 700) < 60 and abs(n[1] - 700) < 60
    assert copies.select("k").distinct().count() == 1000
    poisson = {r["sentiment"]: r["n"] for r in aggregates.class_distribution(sampling.oversample_poisson(df)).collect()}
    assert poisson[2] == 700 and abs(poisson[1] - 700) < 120


PAGE = """<html><script>var x='<div data-hook="review" id="no">';</script><body>
<div id="customer_review-R1" {hook}><span class="a-profile-name">Ann &amp; Bo</span>
<a data-hook="review-title"><i>x</i><span>5 stars</span><span> Great </span></a>
<i data-hook="review-star-rating"><span>4,0 out of 5 stars</span></i>
<span data-hook="review-date">Reviewed in the United States on March 5, 2024</span>
<div data-hook="review-collapsed"><span>Line one
line <b>two</b></span><span>more</span></div>
<span data-hook="helpful-vote-statement">3 of 5 people found this helpful</span></div>
<div id="customer_review-R2" {hook}><span class="a-profile-name">Cy</span>
<a data-hook="review-title"><span>Bad date</span></a><i data-hook="review-star-rating">2.0 out of 5 stars</i>
<span data-hook="review-date">yesterday</span><div data-hook="review-collapsed"><span>t</span></div></div></body></html>"""


@pytest.mark.parametrize("hook, selector", [('data-hook="review"', 1), ("", 2)])
def test_extract_reviews(spark, hook, selector):
    pages = spark.createDataFrame([("B1", PAGE.replace("{hook}", hook)), ("B2", "<html>none</html>")], "asin string, html string")
    blocks = extraction.extract_blocks(pages, extraction.REVIEW_SELECTORS).collect()
    assert [(b["asin"], b["selector"], b["pos"]) for b in blocks] == [("B1", selector, 0), ("B1", selector, 1)]
    good, rejects = extraction.extract_reviews(pages, F.lit(AS_OF))
    assert [r.asDict() for r in good.collect()] == [
        {
            "reviewer_name": "Ann & Bo",
            "asin": "B1",
            "review_id": "R1",
            "title": "Great",
            "overall": 4.0,
            "reviewText": "Line one\nline two",
            "date": "2024-03-05",
            "helpful_votes": 3,
            "total_votes": 5,
            "scrape_time": "2024-03-10 12:00",
        }
    ]
    assert [(r["review_id"], r["reject_reason"]) for r in rejects.collect()] == [("R2", "date")]


def test_extract_links(spark):
    html = '<a class="x" href="/dp/B1/ref?a=1&amp;b=2">p</a><a href="/help">h</a><a href="https://o.example/x/dp/B2">q</a><!-- <a href="/dp/NO/"> -->'
    pages = spark.createDataFrame([("https://shop.example/list?p=1", html)], "url string, html string")
    got = extraction.extract_links(pages).collect()
    assert [(r["link"], r["id"]) for r in got] == [
        ("https://shop.example/dp/B1/ref?a=1&b=2", "B1"),
        ("https://o.example/x/dp/B2", "B2"),
    ]


def test_csv_export_keeps_hard_text(spark):
    values = ['a,b "quoted"', "line\nfeed", " padded ", "", None, 'back\\slash "', "\r\n"]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "k string, v string")
    path = new_folder(spark, "csv")
    sinks.export_reviews(df, path, "csv", ["k", "v"])
    back = {r["k"]: r["v"] for r in readers.read_export(spark, path, "csv", df.schema).collect()}
    assert back == {str(i): v for i, v in enumerate(values)}


def test_export_rejects_other_formats(spark):
    with pytest.raises(ValueError):
        sinks.export_reviews(spark.range(1), "unused", "xml", ["id"])
    with pytest.raises(ValueError):
        readers.read_export(spark, "unused", "xml", spark.range(1).schema)


def test_corrupt_lines_are_kept_apart(spark):
    path = new_folder(spark, "lines")
    lines = [('{"asin":"A","overall":4.0}',), ("not json",), ('{"overall":"bad","asin":"B"}',)]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    got = readers.read_reviews(spark, path, with_corrupt=True).select("asin", "overall", readers.CORRUPT).collect()
    assert {(r["asin"], r["overall"], r[readers.CORRUPT] is None) for r in got} == {("A", 4.0, True), (None, None, False), ("B", None, False)}


def test_stored_results_prune_columns_and_push_filters(spark, reviews):
    path = new_folder(spark, "stored")
    sinks.write_results(reviews, path)
    found = readers.read_results(spark, path, product="HOT").select("overall")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(asin,HOT)" in plan and "title" not in plan.split("ReadSchema")[1]
    assert readers.read_results(spark, path).count() == reviews.count()
    limited = readers.read_results(spark, path, limit=3).collect()
    assert len(limited) == 3
    assert readers.find_review(readers.read_results(spark, path), "r1").count() == reviews.where("review_id = 'r1'").count()


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = aggregates.sentiment_stats(t.facts_only(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double>" in plan


def test_folders_are_below_the_session_s_shared_one(spark):
    before = spark.conf.getAll
    assert new_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/opinara/x-")

    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "s3://bucket/warehouse/"}.get(key, default)

    assert scratch_root(type("S", (), {"conf": Conf()})()) == "s3://bucket/warehouse/opinara"
    assert spark.conf.getAll == before


def test_limit_per_group_beyond_spark_s_own_bound(spark):
    rows = spark.range(40_000, numPartitions=8).select(F.when(F.col("id") % 4 > 0, "hot").otherwise(F.col("id").cast("string")).alias("asin"), "id")
    limited = ranking.limit_per_group(rows, ["asin"], [F.desc("id")], 5000)
    got = limited.where("asin = 'hot'").agg(F.count("*"), F.min("id")).first()
    assert got[0] == 5000 and got[1] == sorted((i for i in range(40_000) if i % 4), reverse=True)[4999]
    assert limited.count() == 15_000


def test_results_are_pruned_by_period(spark):
    path = new_folder(spark, "periods")
    days = spark.range(730).select(F.expr("timestamp'2023-01-01' + make_dt_interval(id)").alias("review_ts"), F.col("id").cast("string").alias("review_id"))
    sinks.write_results(days, path)
    now = F.lit(datetime(2024, 12, 30))
    found = readers.read_results(spark, path, time_range="last-30-days", as_of=now)
    scan = next(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x)
    assert "PartitionFilters: [isnotnull(period" in scan
    assert found.count() == 31 and len(found.inputFiles()) <= len(spark.read.parquet(path).inputFiles())


def test_reviews_by_product_keeps_every_review(spark):
    rows = [(None if i % 10 == 0 else "" if i % 10 == 1 else "HOT" if i % 10 < 9 else f"p{i}", float(i % 5 + 1), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "asin string, overall double, i int").withColumn("sentiment", F.lit(1)).withColumn("sentiment_label", F.lit("Neutral"))
    got = aggregates.reviews_by_product(df).collect()
    assert len(got) == 2000 and {r["total_reviews"] for r in got if r["asin"] is None} == {200}


def test_oversampling_one_row_against_many(spark):
    many = spark.range(1_000_000).select("id", F.lit(0).alias("sentiment")).union(spark.range(1).select((F.col("id") - 1).alias("id"), F.lit(1).alias("sentiment")))
    got = sampling.oversample(many, "id").groupBy("sentiment").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("c")).collect()
    assert {(r["sentiment"], r["n"], r["c"]) for r in got} == {(0, 1_000_000, 1), (1, 1_000_000, 1_000_000)}


@pytest.mark.parametrize(
    "anchor, link",
    [
        ('<a data-href="/dp/WRONG/" href="/dp/RIGHT/x">', "https://shop.com/dp/RIGHT/x"),
        ("<a href='/dp/ONE/'>", "https://shop.com/dp/ONE/"),
        ('<a class="x" href = "https://other.com/dp/A/">', "https://other.com/dp/A/"),
        ('<a href="httpd/dp/B/">', "https://shop.com/list/httpd/dp/B/"),
        ('<a href="//cdn.com/dp/C/">', "https://cdn.com/dp/C/"),
        ('<a href="dp/D/">', None),
        ('<a href="x/dp/D/?a=1&amp;b=2">', "https://shop.com/list/x/dp/D/?a=1&b=2"),
    ],
)
def test_links(spark, anchor, link):
    pages = spark.createDataFrame([("https://shop.com/list/page?x=/a/", f"<p>{anchor}t</a></p>")], "url string, html string")
    assert [r["link"] for r in extraction.extract_links(pages).collect()] == ([link] if link else [])


def test_one_link_per_card(spark):
    html = '<a href="/dp/NAV/">n</a>' + "".join(f'<div class="{extraction.CARD}"><a href="/x">i</a><a href="/dp/{i}/">i</a><a href="/dp/again/">i</a></div>' for i in "AB")
    pages = spark.createDataFrame([("https://shop.com/", html)], "url string, html string")
    assert [r["id"] for r in extraction.extract_links(pages, card=extraction.CARD).collect()] == ["A", "B"]


def test_review_blocks(spark):
    def blocks(html):
        found = extraction.extract_blocks(spark.createDataFrame([(html,)], "html string"), extraction.REVIEW_SELECTORS)
        return [(r["selector"], r["body"]) for r in found.collect()]

    assert blocks("<div data-hook='review' id='customer_review-1'>a<div data-hook=\"review\">b") == [(1, "a"), (1, "b")]
    assert blocks("<div id='customer_review-1'>a") == [(2, "a")]
    assert blocks('<span data-hook="cr-widget-FocalReviews">no reviews</span>') == []
