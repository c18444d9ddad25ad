"""Structured Streaming extensions: appending points once, growing an index, running mosaics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.operators.index import build_index


def append_points(stream: DataFrame, keys: list[str], event_time: str, delay: str, target: str, checkpoint: str):
    """Append points to a Parquet folder, each key once within the watermark; returns the started query (available data, then stop)."""
    once = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def grow_index(stream: DataFrame, delta: float, target: str, checkpoint: str, *, file: str = "src", offset: str = "pt_id"):
    """Index rows of files not indexed before; a batch is written under its own number, so a retry replaces it."""

    def add(batch: DataFrame, batch_id: int) -> None:
        new = build_index(batch, delta, file=file, offset=offset)
        try:
            done = batch.sparkSession.read.parquet(target).where(F.col("batch") != batch_id).select(file).distinct()
            new = new.join(done, file, "left_anti")
        except Exception as missing:  # the first batch has nothing before it
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        new.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_mosaic(stream: DataFrame, field: str, weight: str, keys: list[str]) -> DataFrame:
    """Sums per cell that grow tile by tile (update or complete mode); the mean is ``sum_wz / sum_w``."""
    return stream.where(F.col(field).isNotNull() & ~F.isnan(field)).groupBy(*keys).agg(F.sum(weight).alias("sum_w"), F.sum(F.col(weight) * F.col(field)).alias("sum_wz"))


def windowed_counts(stream: DataFrame, event_time: str, window: str, delay: str, by: list[str]) -> DataFrame:
    """Counts per tumbling window; windows close when the watermark passes them."""
    ts = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    return ts.groupBy(F.window(event_time, window), *by).agg(F.count("*").alias("n"))
