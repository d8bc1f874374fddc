"""Batch and streaming sources. Every source declares its schema, nothing is inferred by a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.operators.filters import dashboard_filter, range_start
from opinara.schema import PERIOD, RESULT_TIME, REVIEW_SCHEMA

CORRUPT = "corrupt_record"
_EMPTY = "\x00"


def read_reviews(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA, with_corrupt: bool = False) -> DataFrame:
    """Reviews from JSON lines. Lines that are no JSON give nulls; ``with_corrupt`` adds their source."""
    if with_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.json(path)


def read_export(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """Reads back what ``sinks.export_reviews`` wrote."""
    if fmt == "json":
        return spark.read.schema(schema).json(path)
    if fmt == "csv":
        # A quoted empty field is an empty text, an unquoted one is null; the mark tells them apart.
        options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "emptyValue": _EMPTY}
        df = spark.read.schema(schema).options(**options).csv(path)
        texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
        return df.replace(_EMPTY, "", subset=texts) if texts else df
    raise ValueError(f"format must be json or csv, not {fmt!r}")


def read_results(
    spark: SparkSession, path: str, *, limit: int | None = None, as_of: Column | None = None, **conditions
) -> DataFrame:
    """Stored results, all or by the conditions of ``dashboard_filter``, newest first under a limit.

    A time range also prunes the folders ``sinks.write_results`` made, one per period: its start,
    written like a period, is no later than any period in the range.
    """
    df = spark.read.parquet(path)
    now = F.current_timestamp() if as_of is None else as_of
    start = range_start(conditions.get("time_range"), now)
    if start is not None and conditions.get("ts_columns", (RESULT_TIME,)) == (RESULT_TIME,):
        df = df.where(F.col("period").cast("string") >= F.date_format(start, PERIOD))
    found = dashboard_filter(df, as_of=now, **conditions)
    if limit is not None:
        found = found.orderBy(F.desc("review_ts"), "review_id", *[c for c in df.columns if c not in ("review_ts", "review_id")]).limit(limit)
    return found


def find_review(df: DataFrame, review_id: str) -> DataFrame:
    """The stored records of one review."""
    return df.where(F.col("review_id") == review_id)


def stream_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """Unbounded source over files as they arrive."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest", **options) -> DataFrame:
    """Unbounded source over a topic; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .options(**options)
        .load()
    )


SPREAD_CONF = "opinara.spread.tasks"


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows dealt out to ``tasks`` tasks, for work that is heavy per row on files that can't be split.

    The number is the caller's, here or as the session's setting ``opinara.spread.tasks``; without one the
    scan's own tasks stay, as they should for any table of many files.
    """
    tasks = tasks or int(df.sparkSession.conf.get(SPREAD_CONF, "0"))
    return df.repartition(tasks) if tasks else df


def parse_json(df: DataFrame, schema: T.StructType, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of a JSON value. Text that is no JSON gives nulls, an unknown field is dropped."""
    return df.select(*keep, F.from_json(F.col(value).cast("string"), schema).alias("data")).select(*keep, "data.*")
