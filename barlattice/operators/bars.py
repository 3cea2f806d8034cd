"""Candles from trades, and their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import q
from . import scan as K


def resample(trades: DataFrame, seconds: int, *, order: str = "trade_id") -> DataFrame:
    """Trades to candles. One shuffle, combined before it; ties in time are
    broken by ``order``."""
    start = F.window("ts", f"{seconds} seconds")["start"]
    at = F.struct("ts", order)
    return (
        trades.groupBy("symbol", start.alias("bar_ts"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("qty").alias("volume"),
        )
    )


def daily(trades: DataFrame) -> DataFrame:
    """Trades with a ``rank_key`` to daily candles."""
    return trades.groupBy("symbol", F.date_trunc("day", "ts").alias("bar_ts")).agg(
        F.min_by("price", "rank_key").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "rank_key").alias("close"),
        F.sum("qty").alias("volume"),
    )


def coarser(bars: DataFrame, seconds: int) -> DataFrame:
    """Candles to longer candles."""
    start = F.window("bar_ts", f"{seconds} seconds")["start"]
    return (
        bars.withColumn("start", start)
        .groupBy("symbol", "start")
        .agg(
            F.min_by("open", "bar_ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "bar_ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("start", "bar_ts")
    )


def indexed(bars: DataFrame) -> DataFrame:
    """``bar_idx`` from 0 in each symbol; all look-backs count bars, not time.
    Days are numbered each for itself, on the bars of the days before them."""
    return K.numbered(bars, ["symbol"], ["bar_ts"], K.day_of("bar_ts"))


def latest(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` candles of each symbol: of the days after which fewer than
    ``n`` follow, ranked each for itself."""
    newer = F.coalesce("scan_n", F.lit(0))
    near = K.with_entries(bars, ["symbol"], K.day_of("bar_ts"), {"scan_n": (F.count("*"), lambda c, w: F.sum(c).over(w))}, back=True).where(newer < n)
    rank = F.row_number().over(K.inside(["symbol"], F.col("bar_ts").desc()))
    return near.withColumn("newest", rank + newer).where(F.col("newest") <= n).drop("newest", "scan_n", "scan_block")


def aligned(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Closes of several symbols at the times that all of them have."""
    return bars.groupBy("bar_ts").pivot("symbol", symbols).agg(F.first("close")).dropna(subset=symbols)


def recent_summary(bars: DataFrame, n: int) -> DataFrame:
    """Bulls, bears, mean body ratio and net change of the newest ``n``."""
    size = F.col("high") - F.col("low")
    body = F.when(size > 0, F.abs(F.col("close") - F.col("open")) / size).otherwise(0.0)
    return (
        latest(bars, n)
        .groupBy("symbol")
        .agg(
            F.count("*").alias("n"),
            F.count(F.when(F.col("close") > F.col("open"), 1)).alias("bullish"),
            F.count(F.when(F.col("close") < F.col("open"), 1)).alias("bearish"),
            q(F.avg(body)).alias("avg_body_ratio"),
            q((F.max_by("close", "bar_ts") - F.min_by("open", "bar_ts")) / F.min_by("open", "bar_ts") * 100).alias("net_pct"),
        )
    )
