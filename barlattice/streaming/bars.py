"""Candles from a stream of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(trades: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Candles of a stream with the columns of the market ticks view.

    State per open bar is one row of partial aggregates; a bar is closed when
    the watermark passes its end, and trades later than ``late`` are dropped by
    the engine. A stream's watermark needs an instant, so local times count as UTC.
    """
    at = F.struct("ts", "trade_id")
    return (
        trades.withColumn("event_time", F.col("ts").cast("timestamp"))
        .withWatermark("event_time", late)
        .groupBy("symbol", F.window("event_time", width).alias("w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"))
        .select("symbol", F.col("w.start").cast("timestamp_ntz").alias("bar_ts"), "open", "high", "low", "close", "volume")
    )
