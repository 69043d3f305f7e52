"""Streams of detections: ingestion of new frames, sliding counts, segments by gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sliding_counts(stream: DataFrame, time: str = "ts", window: str = "45 minutes", slide: str = "15 minutes", late: str = "1 hour", key: str | None = None) -> DataFrame:
    """Rows per sliding window (and key); rows later than ``late`` behind the newest are dropped by the watermark."""
    keys = [F.window(time, window, slide).alias("w")] + ([F.col(key)] if key else [])
    out = stream.withWatermark(time, late).groupBy(*keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *([key] if key else []), "n")


def segments(stream: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Track segments as session windows: a key's rows with no gap longer than ``gap``."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def ingest_new_frames(stream: DataFrame, path: str, checkpoint: str, frame: str = "t") -> StreamingQuery:
    """Appends each micro-batch's frames to a table partitioned by frame, and stops when all input is read.

    A batch that is delivered again writes the same folder of its own, so that a restart repeats no row.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").partitionBy(frame).parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
