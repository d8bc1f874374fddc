"""A stored table of records that come again: changes by key, merged when read, compacted by bucket.

A record's key gives its bucket. A batch is written as a delta, one folder per batch with folders per bucket in it, so a
replayed batch replaces itself and no other row is read or written. Reading takes the base of each bucket and
the deltas after it, the newest record of each key. Compacting rewrites only buckets that have deltas; the base
of every other bucket stays the files it is. A version lists each bucket's base and the last delta
in it; what no kept version names can be removed, so the number of folders stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators.ranking import dedup_latest, limit_per_group
from opinara.sources.sinks import BatchSink
from opinara.workspace import names_in, remove

_BATCH, _BUCKET = "_batch", "_bucket"


class KeyedTable:
    """Records by ``keys``; of those with equal keys the one with the latest ``ts`` holds, of equals that of the later batch.

    ``buckets`` is fixed when the table is begun. One writer at a time; readers may come at any time, and see a version
    whole. A reader that is slower than ``keep`` compactions with clean-up may find its files gone.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], ts: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.ts, self.buckets = spark, path, keys, ts, buckets

    def bucket_of(self, *values: Column) -> Column:
        return F.pmod(F.xxhash64(*values), F.lit(self.buckets)).cast("int")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Writes the newest record of each key in the batch; batches come in the order of their numbers, from 0."""
        newest = dedup_latest(batch, self.keys, self.ts).withColumn(_BUCKET, self.bucket_of(*[F.col(k) for k in self.keys]))
        # Rows of a bucket meet in one task, or in several if they are many, so a batch has few files.
        newest.hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/delta/{_BATCH}={batch_id}")

    def sink(self, every: int = 20, keep: int = 2) -> BatchSink:
        """Sink for ``foreachBatch`` that compacts and cleans up after ``every`` batches."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.upsert(batch, batch_id)
            if (batch_id + 1) % every == 0:
                self.compact()
                self.clean(keep)

        return write

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind."""
        return sorted(int(n.split("=")[1]) for n in names_in(self.spark, f"{self.path}/{kind}") if "=" in n)

    def _version(self) -> tuple[int, int, dict[int, int]]:
        """The newest version, the last delta in it, and each bucket's base; a bucket without rows has none."""
        numbers = self._numbers("versions")
        if not numbers:
            return -1, -1, {}
        rows = self.spark.read.parquet(f"{self.path}/versions/version={numbers[-1]}").collect()
        return numbers[-1], max(r["last"] for r in rows), {r["bucket"]: r["base"] for r in rows if r["base"] is not None}

    def _deltas(self, after: int) -> list[int]:
        return [n for n in self._numbers("delta") if n > after]

    def _read_deltas(self, numbers: list[int]) -> DataFrame | None:
        if not numbers:
            return None
        folders = [f"{self.path}/delta/{_BATCH}={n}" for n in numbers]
        return self.spark.read.option("basePath", f"{self.path}/delta").parquet(*folders)

    def _read_bases(self, bases: dict[int, int]) -> DataFrame | None:
        if not bases:
            return None
        folders = [f"{self.path}/base/{_BATCH}={base}/{_BUCKET}={bucket}" for bucket, base in sorted(bases.items())]
        return self.spark.read.option("basePath", f"{self.path}/base").parquet(*folders)

    def _merged(self, bases: dict[int, int], deltas: list[int], only: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame | None:
        parts = [only(df) for df in (self._read_bases(bases), self._read_deltas(deltas)) if df is not None]
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        # A base has the number of the last delta in it, so later batches come first among equal times.
        return limit_per_group(rows, self.keys, [F.desc(self.ts), F.desc(_BATCH)], 1) if deltas else rows

    def read(self) -> DataFrame | None:
        """The newest record of each key; null for a table that nothing was written to."""
        _, last, bases = self._version()
        rows = self._merged(bases, self._deltas(last))
        return None if rows is None else rows.drop(_BATCH, _BUCKET)

    def find(self, *values: object) -> DataFrame | None:
        """The record of one key; only its bucket is read."""
        _, last, bases = self._version()
        bucket = self.spark.range(1).select(self.bucket_of(*[F.lit(v) for v in values])).first()[0]
        same = [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(self.keys, values)]

        def only(df: DataFrame) -> DataFrame:
            found = df.where(F.col(_BUCKET) == bucket)
            for s in same:
                found = found.where(s)
            return found

        rows = self._merged({b: v for b, v in bases.items() if b == bucket}, self._deltas(last), only)
        return None if rows is None else rows.drop(_BATCH, _BUCKET)

    def compact(self) -> None:
        """Puts the deltas into the bases of the buckets they touch, and makes that a new version."""
        version, last, bases = self._version()
        deltas = self._deltas(last)
        if not deltas:
            return
        touched = [r[0] for r in self._read_deltas(deltas).select(_BUCKET).distinct().collect()]
        rows = self._merged({b: v for b, v in bases.items() if b in touched}, deltas)
        rows.drop(_BATCH).hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/base/{_BATCH}={deltas[-1]}")
        now = [(b, deltas[-1] if b in touched else bases.get(b), deltas[-1]) for b in range(self.buckets)]
        # Written whole or not at all: a folder without its mark of success is no version.
        listed = self.spark.createDataFrame(now, "bucket int, base int, last int")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={version + 1}")

    def clean(self, keep: int = 2) -> None:
        """Removes deltas, bases and versions that none of the last ``keep`` versions needs."""
        versions = self._numbers("versions")
        if not versions:
            return
        kept = versions[-keep:]
        rows = self.spark.read.option("basePath", f"{self.path}/versions").parquet(*[f"{self.path}/versions/version={v}" for v in kept]).collect()
        used = {(r["base"], r["bucket"]) for r in rows if r["base"] is not None}
        oldest = min(r["last"] for r in rows)
        for n in self._numbers("delta"):
            if n <= oldest:
                remove(self.spark, f"{self.path}/delta/{_BATCH}={n}")
        for n in self._numbers("base"):
            folder = f"{self.path}/base/{_BATCH}={n}"
            buckets = {int(x.split("=")[1]) for x in names_in(self.spark, folder, finished=False) if "=" in x}
            if n <= max(r["last"] for r in rows):
                for b in buckets:
                    if (n, b) not in used:
                        remove(self.spark, f"{folder}/{_BUCKET}={b}")
                if not any((n, b) in used for b in buckets):
                    remove(self.spark, folder)
        for v in versions[:-keep]:
            remove(self.spark, f"{self.path}/versions/version={v}")
