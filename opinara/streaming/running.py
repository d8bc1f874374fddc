"""Counters, rankings and time lines that follow a stream.

Counts live in the state store. Each batch writes only the rows it changed, so neither the sink nor
the driver ever sees the whole state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara.operators.aggregates import category_counts, known_events
from opinara.operators.ranking import dedup_latest
from opinara.sources.sinks import BatchSink, read_tiers, tiered_batches
from opinara.workspace import names_in, remove

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State of queries started inside lives in RocksDB instead of the executors' heap; the session's setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def running_counters(events: DataFrame) -> DataFrame:
    """Per product: events by category so far. Start in update mode."""
    return known_events(events).groupBy("asin").agg(*category_counts(F.col("category")))


def hourly_counts(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events per hour and category. Rows later than ``delay`` behind the newest are left out; ``hourly_sink`` keeps them apart.

    Append mode emits an hour once it is complete, update mode whenever its count changes.
    """
    return (
        known_events(events)
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 hour").alias("window"), "category")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("hour"), "category", "n")
    )


def hourly_sink(path: str, ts: str = "ts", delay: str = "1 hour", every: int = 10) -> BatchSink:
    """Sink for ``foreachBatch`` over events: counts per hour and category below ``path/hours``, and rows that come too late below ``path/late``.

    An hour is closed for a batch when it ended ``delay`` or more before the newest event of the batches before it, as with a
    watermark. Its late rows are kept whole, a folder per batch, and not counted, so that hours once closed stay as they are; nothing is lost, on time and
    late rows are all rows. What batches have counted is put together in tiers. Rows without a time are on time, in an hour of their own.
    """
    hour = F.date_trunc("hour", ts)
    add = lambda rows: rows.groupBy("hour", "category").agg(F.sum("n").alias("n"))
    count = tiered_batches(f"{path}/hours", every, combine=add)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, marks = batch.sparkSession, f"{path}/marks"
        seen = spark.read.parquet(f"{marks}/batch_id={batch_id - 1}").first()[0] if batch_id else None
        closed = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(hour + F.expr("INTERVAL 1 HOUR") <= closed, F.lit(False))
        events = known_events(batch).persist()
        try:
            events.where(late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
            count(events.where(~late).groupBy(hour.alias("hour"), "category").agg(F.count(F.lit(1)).alias("n")), batch_id)
            newest = events.agg(F.greatest(F.max(ts).cast("timestamp"), F.lit(seen).cast("timestamp")).alias("seen"))
            newest.coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")
        finally:
            events.unpersist()
        for name in names_in(spark, marks):
            if int(name.split("=")[1]) < batch_id - 1:
                remove(spark, f"{marks}/{name}")

    return write


def hours_so_far(spark: SparkSession, path: str, every: int = 10) -> DataFrame:
    """``hour, category, n`` of the rows that came on time."""
    return read_tiers(spark, f"{path}/hours", every).groupBy("hour", "category").agg(F.sum("n").alias("n"))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The events that came too late, with the batch that brought them."""
    return spark.read.parquet(f"{path}/late")


def drop_redelivered(records: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Drops records whose key came within ``delay`` before."""
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def versioned_rows(path: str, keys: list[str], every: int = 20) -> BatchSink:
    """Sink for update mode: the changed rows of each batch, and a snapshot of all rows after ``every`` batches.

    A snapshot is made of the one before it and the batches since, so reading never goes further back. Both kinds of
    folders are named by batch, and a replay writes the same one again. After a snapshot, what came before the last
    one is removed: a replay of this batch needs that one and the changes since, a reader the same. Changes go once more than
    twice ``every`` are there, so there are never three times as many, and no more than two snapshots.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")
        if (batch_id + 1) % every == 0:
            spark = batch.sparkSession
            rows = _rows_at(spark, path, keys, batch_id, every, batch_id - every)
            rows.write.mode("overwrite").parquet(f"{path}/snapshots/batch_id={batch_id}")
            for kind, last in (("changes", batch_id - every), ("snapshots", batch_id - every - 1)):
                names = names_in(spark, f"{path}/{kind}")
                if kind == "changes" and len(names) <= 2 * every:
                    continue
                for name in names:
                    if int(name.split("=")[1]) <= last:
                        remove(spark, f"{path}/{kind}/{name}")

    return write


def _rows_at(spark: SparkSession, path: str, keys: list[str], last: int, every: int, snapshot: int) -> DataFrame:
    """Rows as of batch ``last``, from the snapshot of an earlier batch (if not negative) and the changes after it."""
    folders = {i: f"{path}/changes/batch_id={i}" for i in range(max(snapshot, -1) + 1, last + 1)}
    versions = [spark.read.parquet(folder).withColumn("_version", F.lit(i)) for i, folder in folders.items()]
    if snapshot >= 0:
        versions.append(spark.read.parquet(f"{path}/snapshots/batch_id={snapshot}").withColumn("_version", F.lit(snapshot)))
    return dedup_latest(reduce(DataFrame.unionByName, versions), keys, "_version").drop("_version")


def current_rows(spark: SparkSession, path: str, keys: list[str], every: int = 20) -> DataFrame:
    """The newest version of each row that ``versioned_rows`` stored: the last snapshot and the changes after it."""
    last = max(int(name.split("=")[1]) for name in names_in(spark, f"{path}/changes"))
    return _rows_at(spark, path, keys, last, every, (last + 1) // every * every - 1)


def best_so_far(path: str, order: list[Column], n: int, key: str | None = None) -> BatchSink:
    """Sink that keeps the ``n`` best rows seen, as one small folder per batch.

    The best rows of a batch are the best among its own and those of the batch before it. With a
    ``key``, a row may come again with a rank that never falls (a counter); then an old version
    ranks behind its new one, and the best 2n hold the newest versions of the best n.
    """
    by_key = Window.partitionBy(key).orderBy(F.desc("_version")) if key else None

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_version", F.lit(batch_id))
        if batch_id > 0:
            before = batch.sparkSession.read.schema(rows.schema).parquet(f"{path}/batch_id={batch_id - 1}")
            rows = rows.unionByName(before)
        if key:
            candidates = rows.orderBy(*order, F.desc("_version")).limit(2 * n)
            rows = candidates.withColumn("_rank", F.row_number().over(by_key)).where("_rank = 1").drop("_rank")
        best = rows.orderBy(*order).limit(n)
        best.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def current_best(spark: SparkSession, path: str) -> DataFrame:
    """What ``best_so_far`` stored last."""
    stored = spark.read.parquet(path)
    newest = stored.agg(F.max("batch_id")).scalar()
    return stored.where(F.col("batch_id") == newest).drop("batch_id", "_version")
