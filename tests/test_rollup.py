"""Counts that are kept up equal those of a scan."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opinara.operators import aggregates, filters, rollup
from opinara.workspace import names_in, new_folder

SCHEMA = "asin string, title string, sentiment int, sentiment_label string, review_ts timestamp"


def _results(n=400):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    kinds = [(0, None), (1, "neutral"), (2, "Positive"), (None, "negative"), (None, None), (7, "odd")]
    return [
        (rng.choice(["A", "B", "", None]), rng.choice(["t1", "t2", "", None]), *rng.choice(kinds), rng.choice([None, start + dt.timedelta(hours=rng.randint(0, 24 * 120))]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("conditions", [{}, {"time_range": "30d"}, {"time_range": "24h", "product": "A"}, {"sentiment": "Positive"}, {"product": "all", "time_range": "all-time"}])
def test_equal_a_scan(spark, conditions):
    df = spark.createDataFrame(_results(), SCHEMA).withColumn("part", F.pmod(F.hash("review_ts", "asin"), F.lit(10))).cache()
    path = new_folder(spark, "rollup-test")
    write = rollup.rollup_sink(path, every=3)
    for i in (0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 8, 9):
        write(df.where(F.col("part") == i), i)
    kept = rollup.read_rollup(spark, path, every=3)
    as_of = F.lit(dt.datetime(2024, 4, 20, 13, 30))
    stats = rollup.rolled_stats(kept, df, as_of, **conditions).first()
    assert stats == aggregates.sentiment_stats(filters.dashboard_filter(df, as_of=as_of, **conditions)).first()
    if not conditions:
        counters = lambda x: sorted(map(tuple, x.select("asin", *aggregates.COUNTERS, "title", "first_seen").collect()))
        assert counters(rollup.rolled_counters(kept)) == counters(aggregates.product_counters(df))
        assert names_in(spark, f"{path}/tier=2") == ["last=8"]


def test_edges(spark):
    empty = rollup.partial_counts(spark.createDataFrame([], SCHEMA))
    assert tuple(rollup.rolled_stats(empty, spark.createDataFrame([], SCHEMA), F.current_timestamp(), time_range="7d").first()) == (0, 0, 0, 0)
    assert rollup.rolled_counters(rollup.combined(empty)).count() == 0


def test_a_range_reads_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    days = spark.range(20_000).select(F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 1000).cast("int")).alias("day"), F.concat(F.lit("P"), F.col("id") % 20).alias("asin"))
    partials = days.select("day", "asin", F.lit("positive").alias("category"), F.lit(1).cast("long").alias("n"), F.col("day").cast("timestamp").alias("first_seen"), F.lit("t").alias("title"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rollup.combined(partials).write.parquet(f"{tmp_path}/rows")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "rows").glob("*.parquet")]
    spans = sorted((m.row_group(i).column(0).statistics.min, m.row_group(i).column(0).statistics.max) for m in files for i in range(m.num_row_groups))
    assert len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
