"""Rolling demand over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; parquet may hold one without."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def rolling_demand(
    df: DataFrame, stop: str = "stop_id", time: str = "ts", size: str = "1 hour",
    slide: str | None = None, delay: str = "1 hour",
) -> DataFrame:
    """Events per stop and window; rows later than ``delay`` are dropped on a stream."""
    events = event_time(df, time)
    if events.isStreaming:
        events = events.withWatermark(time, delay)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return (
        events.groupBy(window.alias("w"), stop)
        .agg(F.count("*").alias("demand"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), stop, "demand")
    )


def write_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to a parquet folder until the source is drained."""
    return (
        df.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
