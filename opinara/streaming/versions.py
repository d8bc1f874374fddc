"""Models that change while a stream is scored.

A store has a folder per version, which counts once its model is whole and marked as published. Each batch is scored by the newest
version there is when it first runs; the choice is written before the scores, so that a replayed batch is scored by the
same version again, and the version stands in each record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators.modelling import load_model, save_model
from opinara.sources.sinks import BatchSink
from opinara.streaming.scoring import scored
from opinara.workspace import names_in

VERSION = "model_version"


class ModelStore:
    """Versions of a model below ``path``, from 0. ``save`` and ``load`` take a folder; pipelines are the default. One publisher at a time."""

    def __init__(self, spark: SparkSession, path: str, save: Callable[[Model, str], None] = save_model, load: Callable[[str], Model] = load_model):
        self.spark, self.path, self._save, self._load = spark, path, save, load
        self._loaded: dict[int, Model] = {}

    def folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def versions(self) -> list[int]:
        """The published versions."""
        numbers = [int(n.split("=")[1]) for n in names_in(self.spark, self.path, finished=False) if n.startswith("version=")]
        return sorted(n for n in numbers if "published" in names_in(self.spark, self.folder(n)))

    def publish(self, model: Model) -> int:
        """Stores a model as the next version; readers see it once all of it is there."""
        version = max(self.versions(), default=-1) + 1
        self._save(model, f"{self.folder(version)}/model")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder(version)}/published")
        return version

    def load(self, version: int) -> Model:
        """The model of a version; the last one loaded is kept."""
        if version not in self._loaded:
            self._loaded = {version: self._load(f"{self.folder(version)}/model")}
        return self._loaded[version]

    def choose(self, choices: str, batch_id: int) -> int:
        """The version a batch is scored by: the one written at its first run, or else the newest, which is then written."""
        folder = f"{choices}/batch_id={batch_id}"
        if folder.rsplit("/", 1)[1] in names_in(self.spark, choices):
            return self.spark.read.parquet(folder).first()[0]
        published = self.versions()
        if not published:
            raise LookupError(f"no model is published in {self.path}")
        self.spark.createDataFrame([(published[-1],)], "version int").coalesce(1).write.mode("overwrite").parquet(folder)
        return published[-1]


def versioned_scores(store: ModelStore, path: str, score: Callable[[DataFrame, Model], DataFrame] = scored) -> BatchSink:
    """Sink for ``foreachBatch`` over prepared records: scored rows with their ``model_version``, a folder per batch in ``path/rows``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        version = store.choose(f"{path}/choices", batch_id)
        rows = score(batch, store.load(version)).withColumn(VERSION, F.lit(version))
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")

    return write
