"""Batch and streaming sinks. Rows go from the executors to storage, never through the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opinara.schema import EXPORT_COLUMNS, PERIOD, RESULT_TIME
from opinara.workspace import names_in, remove

_ROWS_PER_FILE = 50_000


def json_value(df: DataFrame, *columns: str) -> Column:
    """The named columns, or all, as one JSON text; null fields are left out."""
    return F.to_json(F.struct(*(columns or df.columns)))


def json_envelope(df: DataFrame) -> DataFrame:
    """One ``value`` column for a topic."""
    return df.select(json_value(df).alias("value"))


def kafka_envelope(df: DataFrame, keys: tuple[str, ...] = ("asin", "review_id")) -> DataFrame:
    """``key`` from the key columns and ``value`` with the whole record."""
    return df.select(F.concat_ws("_", *keys).alias("key"), json_value(df).alias("value"))


def write_kafka(df: DataFrame, servers: str, topic: str) -> None:
    """Sends keyed records to a topic; needs the Kafka connector on the class path."""
    kafka_envelope(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def export_reviews(df: DataFrame, path: str, fmt: str, columns: list[str] | None = None) -> None:
    """All rows as ``json`` or ``csv`` in fixed column order."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"format must be json or csv, not {fmt!r}")
    writer = df.select(*(columns or EXPORT_COLUMNS)).write.mode("overwrite")
    if fmt == "json":
        writer.json(path)
        return
    # A quoted line feed keeps a reader from splitting a file, so files stay of bounded length.
    writer.options(
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        maxRecordsPerFile=_ROWS_PER_FILE,
    ).csv(path)


def write_results(df: DataFrame, path: str, cluster: tuple[str, ...] = ("asin", "review_id"), row_group: int | None = None) -> None:
    """Stores results in one folder per month, for pruning by time, and within a month by product.

    The rebalance hint lets adaptive execution split a hot period and merge small ones. Within a file rows are in the order of ``cluster``, so
    that a product is in few row groups by their least and greatest values; its other columns have bloom filters, so that
    a row group without the value asked for is left out, too. Columns that ``df`` lacks are passed over.
    """
    dated = df.withColumn("period", F.date_format(RESULT_TIME, PERIOD))
    by = [c for c in cluster if c in df.columns]
    rows = dated.hint("rebalance", "period").sortWithinPartitions("period", *by)
    writer = rows.write.mode("overwrite").options(**{f"parquet.bloom.filter.enabled#{c}": "true" for c in by})
    if row_group is not None:
        writer = writer.option("parquet.block.size", row_group)
    writer.partitionBy("period").parquet(path)


BatchSink = Callable[[DataFrame, int], None]


def batch_folder(path: str) -> BatchSink:
    """Sink for ``foreachBatch``: one folder per batch, so a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def tiered_batches(path: str, every: int = 10, combine: Callable[[DataFrame], DataFrame] | None = None) -> BatchSink:
    """Sink for ``foreachBatch``: a folder per batch, of which each ``every`` are put together into one, and so on.

    A folder is named by its tier and its last batch: ``tier=0`` holds one batch, each higher tier ``every`` folders of the one below. So
    after n batches there are about ``every`` folders for each power of ``every`` up to n, and each row is rewritten that
    many times, or with ``combine``, what that makes of the rows put together. Folders that a higher one holds are removed one batch later, so that a replayed batch finds what
    it found first.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for tier, last in _obsolete(_tiers(spark, path), every, before=batch_id):
            remove(spark, f"{path}/tier={tier}/last={last}")
        batch.write.mode("overwrite").parquet(f"{path}/tier=0/last={batch_id}")
        tier, width = 1, every
        while (batch_id + 1) % width == 0:
            below = width // every
            inside = [f"{path}/tier={tier - 1}/last={batch_id - below * k}" for k in range(every)]
            rows = spark.read.schema(batch.schema).parquet(*inside)
            (combine(rows) if combine else rows).write.mode("overwrite").parquet(f"{path}/tier={tier}/last={batch_id}")
            tier, width = tier + 1, width * every

    return write


def _tiers(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(tier, last batch) of the finished folders."""
    tiers = [int(n.split("=")[1]) for n in names_in(spark, path, finished=False) if n.startswith("tier=")]
    return [(t, int(n.split("=")[1])) for t in tiers for n in names_in(spark, f"{path}/tier={t}")]


def _obsolete(folders: list[tuple[int, int]], every: int, before: int | None = None) -> list[tuple[int, int]]:
    """Folders whose batches a higher one holds, one that was made before the batch ``before``."""
    held = [(t, last - every**t + 1, last) for t, last in folders if before is None or last < before]
    return [(t, last) for t, last in folders if any(u > t and first <= last <= end for u, first, end in held)]


def read_tiers(spark: SparkSession, path: str, every: int = 10) -> DataFrame:
    """All rows that ``tiered_batches`` stored, each once."""
    folders = _tiers(spark, path)
    gone = set(_obsolete(folders, every))
    return spark.read.parquet(*[f"{path}/tier={t}/last={last}" for t, last in sorted(folders) if (t, last) not in gone])


def fan_out(*sinks: BatchSink) -> BatchSink:
    """Several sinks for one stream: the batch is computed once and kept while all of them write.

    A sink that fails fails the batch, which is then replayed; nothing is lost in silence.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def kafka_sink(servers: str, topic: str) -> BatchSink:
    """Sink for ``foreachBatch`` to a topic."""

    def write(batch: DataFrame, batch_id: int) -> None:
        json_envelope(batch).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return write


def console_sink(rows: int = 20) -> BatchSink:
    """Sink for ``foreachBatch`` that prints the first rows of a batch, for debugging."""

    def write(batch: DataFrame, batch_id: int) -> None:
        print(f"batch {batch_id}")
        batch.show(rows, truncate=False)

    return write


def start(
    stream: DataFrame, sink: BatchSink, checkpoint: str, name: str, mode: str = "append", available_now: bool = False
) -> StreamingQuery:
    """Starts a named query with its own checkpoint folder, from which a restart resumes."""
    writer = (
        stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str, name: str) -> StreamingQuery:
    """JSON records of an append-only stream to a topic."""
    return (
        json_envelope(stream)
        .writeStream.format("kafka")
        .queryName(name)
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .start()
    )


def run_available(stream: DataFrame, sink: BatchSink, checkpoint: str, name: str, mode: str = "append") -> None:
    """Works off what is there and returns; fails if the query failed."""
    start(stream, sink, checkpoint, name, mode, available_now=True).awaitTermination()
