"""Learned scores and delivery snapshots from streams of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import LEAST, MOST, fold_scores


def fold_batch(scores: DataFrame | None, events: DataFrame) -> DataFrame:
    """(kind, feature, score): known scores carried on by a batch of events(kind, feature, seq, delta)."""
    if scores is None:
        return fold_scores(events)
    # a known score is the first step of its feature, before all events of the batch
    known = scores.select("kind", "feature", F.lit(-1).cast("long").alias("seq"), F.col("score").cast("long").alias("delta"))
    both = events.select("kind", "feature", F.col("seq").cast("long").alias("seq"), F.col("delta").cast("long").alias("delta")).unionByName(known)
    return fold_scores(both)


def learn(spark: SparkSession, events: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the learned scores under `folder`/v<batch> up to date with a stream of events.

    Each batch writes a new version and then its name, so a batch that is run again replaces its own version only.
    """

    def step(batch: DataFrame, number: int) -> None:
        older = f"{folder}/v{number - 1}"
        scores = batch.sparkSession.read.parquet(older) if number else None
        fold_batch(scores, batch).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def snapshots(results: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, seconds: int = 5) -> StreamingQuery:
    """Calls write with the finished rows of each micro-batch, every few seconds while there are any."""

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            write(batch)

    return results.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


__all__ = ["LEAST", "MOST", "fold_batch", "learn", "snapshots"]
