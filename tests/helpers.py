"""Candles for tests."""

from __future__ import annotations

from datetime import datetime, timedelta

BARS = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, rows, start="2024-01-01 00:00:00", minutes=60, symbol="X"):
    """Rows of (open, high, low, close) at even steps."""
    t0 = datetime.fromisoformat(start)
    data = [(symbol, t0 + timedelta(minutes=minutes * i), float(o), float(h), float(l), float(c), 1.0) for i, (o, h, l, c) in enumerate(rows)]
    return spark.createDataFrame(data, BARS)


def indexed(spark, rows, **kw):
    from barlattice.operators.bars import indexed as index

    return index(bars(spark, rows, **kw))


def flat(prices):
    return [(p, p, p, p) for p in prices]
