"""Incremental labelling and agreement monitoring as Structured Streaming (an extension: the batch operators need none of it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def label_incrementally(stream: DataFrame, classify: Callable[[DataFrame], DataFrame], *, path: str, checkpoint: str, id_column: str = "id") -> StreamingQuery:
    """Label ids that the Parquet table at path doesn't hold yet, batch by batch; classify returns id, sentiment_label, confidence_score."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([id_column])
        try:
            done = spark.read.parquet(path).select(id_column)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            fresh = fresh.join(done, id_column, "left_anti")
        classify(fresh).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def agreement_by_window(stream: DataFrame, *, time_column: str = "ts", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """window, n, agreement of two label columns (label_a, label_b), late rows dropped after the watermark."""
    agree = (F.col("label_a") == F.col("label_b")).cast("double")
    return stream.withWatermark(time_column, delay).groupBy(F.window(time_column, window)).agg(F.count(F.lit(1)).alias("n"), F.avg(agree).alias("agreement"))
