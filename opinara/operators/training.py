"""The training job: from a file of reviews to a chosen, tested and stored model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators import metrics, modelling
from opinara.schema import TRAINING_SCHEMA
from opinara.sources.readers import read_reviews
from opinara.streaming.scoring import prepare_training

KEY = "row_key"


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """Prepared rows of a training file, with a key by content, so that equal reviews share a split."""
    rows = prepare_training(read_reviews(spark, path, TRAINING_SCHEMA).where(F.col("overall").isNotNull()))
    return rows.withColumn(KEY, F.md5(F.concat_ws("\n", "reviewText", "summary").cast("binary")))


def run_training(spark: SparkSession, path: str, report: str, model: str, board: str | None = None, **choice) -> modelling.Candidate:
    """Trains on the file at ``path``, writes the winner's statistics on the test part to ``report``, and the winner to ``model``.

    With ``board`` the candidates are written there, each with its validation figures or its error.
    ``choice`` goes to ``train_and_choose``. Splitting comes first, so neither training nor choosing sees the test part.
    """
    best, candidates, test = modelling.train_and_choose(training_rows(spark, path), KEY, **choice)
    counts = metrics.confusion_counts(best.model.transform(test), "sentiment")
    metrics.model_statistics(counts).write.mode("overwrite").parquet(report)
    if board:
        modelling.leaderboard(spark, candidates, best).write.mode("overwrite").parquet(board)
    modelling.save_model(best.model, model)
    return best
