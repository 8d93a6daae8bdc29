"""Incremental evaluation: batches of new predictions keep per-class counts up to date.

A stream of predicted boxes is matched to the ground truth batch by batch; each image must arrive
whole in one batch.  A batch's counts are written under its number, so that a replay overwrites
itself, and reading adds up all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev


def maintain_counts(spark: SparkSession, source: str, schema, gt: DataFrame, place: str, iou_threshold: float = 0.5, max_files: int = 100) -> None:
    """Takes in all prediction files under ``source`` that are new since the last call."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def commit(batch: DataFrame, number: int) -> None:
        seen = batch.select("image").distinct()
        counts = ev.counts_by_class(ev.reindex(gt.join(seen, "image", "left_semi")), ev.reindex(batch), iou_threshold)
        counts.write.mode("overwrite").parquet(f"{place}/counts/batch={number}")

    stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()


def current_counts(spark: SparkSession, place: str) -> DataFrame:
    rows = spark.read.parquet(f"{place}/counts")
    return rows.groupBy("class_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
