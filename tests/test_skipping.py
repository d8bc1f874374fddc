"""Stored results are read by few row groups."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opinara.operators.filters import dashboard_filter
from opinara.sources.readers import find_review
from opinara.sources.sinks import write_results
from opinara.workspace import new_folder


def rows_scanned(df):
    """Rows the scans of a query gave, after leaving out row groups."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture
def results(spark):
    n, path = 60_000, new_folder(spark, "clustered")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    df = spark.range(n).select(
        F.concat(F.lit("P"), F.pmod(F.xxhash64("id"), F.lit(300))).alias("asin"),
        F.concat(F.lit("R"), F.xxhash64("id")).alias("review_id"),
        F.concat(F.md5(F.col("id").cast("string")), F.sha2(F.col("id").cast("string"), 512)).alias("review_text"),
        F.lit(dt.datetime(2024, 3, 1)).alias("review_ts"),
    )
    write_results(df.coalesce(1), path, row_group=256 << 10)
    yield spark.read.parquet(path), n, df.where("id = 77").first().review_id
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_few_rows_are_read(results):
    stored, n, review_id = results
    one = find_review(stored, review_id)
    assert rows_scanned(one) < n / 4 and one.count() == 1
    product = dashboard_filter(stored, product="P7")
    assert rows_scanned(product) < n / 4 and product.count() == stored.select("asin").where(F.col("asin") == "P7").count() > 0
    assert rows_scanned(find_review(stored, "none")) < n / 4
    assert rows_scanned(stored.where(F.contains("review_text", F.lit("x")))) > n / 2


def test_without_the_columns(spark):
    path = new_folder(spark, "plain")
    write_results(spark.createDataFrame([(1, dt.datetime(2024, 3, 1)), (2, None)], "k int, review_ts timestamp"), path)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2]
