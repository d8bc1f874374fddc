"""Folders for data a job writes on its way: checkpoints, batch tables, round trips.

Executors and driver must all see them, so they live below ``spark.checkpoint.dir``, or below the
warehouse folder of a session without that setting. The session's settings stay as they are.
Everything is below ``scratch_root``; a caller that has used up its results may remove that folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that holds all intermediate data of this library in this session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/opinara"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path below the scratch root that no other run uses."""
    return f"{scratch_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str, row_group: int | None = None) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder: computed once, with no lineage behind it.

    ``row_group`` is the size in bytes of what a task holds back before it writes, for wide rows made by a job that needs its memory.
    """
    spark = df.sparkSession
    folder = new_folder(spark, purpose)
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    writer.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, jvm


def names_in(spark: SparkSession, folder: str, finished: bool = True) -> list[str]:
    """Names of the folders in ``folder``, none if it isn't there; with ``finished`` only of those whose writer has succeeded."""
    files, place, jvm = _file_system(spark, folder)
    if not files.exists(place):
        return []
    inside = [s.getPath() for s in files.listStatus(place) if s.isDirectory()]
    return [p.getName() for p in inside if not finished or files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder with all in it; one that isn't there is no error."""
    files, place, _ = _file_system(spark, folder)
    files.delete(place, True)
