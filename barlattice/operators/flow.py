"""Order flow, positioning, position sizing, session clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import large_trade, q, tick_of
from . import scan as K


def footprint_levels(trades: DataFrame, seconds: int) -> DataFrame:
    """Volumes and counts by side at each price level of each bar. The first
    trade of a bar sets its tick.

    Trades are read once and summed by price, before the shuffle already; the tick
    is then found among a bar's prices, and prices are summed to levels.
    """
    start = F.window("ts", f"{seconds} seconds")["start"]
    buy = ~F.col("is_buyer_maker")
    prices = trades.groupBy("symbol", start.alias("bar_ts"), "price").agg(
        F.sum(F.when(buy, F.col("qty")).otherwise(0.0)).alias("bought"), F.sum(F.when(~buy, F.col("qty")).otherwise(0.0)).alias("sold"),
        F.count(F.when(buy, 1)).alias("buys"), F.count(F.when(~buy, 1)).alias("sells"), F.min(F.struct("ts", "trade_id")).alias("first"),
    )
    tick = tick_of(F.min_by("price", "first").over(Window.partitionBy("symbol", "bar_ts")))
    levelled = prices.withColumn("tick", tick).withColumn("level", F.floor(F.col("price") / F.col("tick")) * F.col("tick"))
    return levelled.groupBy("symbol", "bar_ts", "level").agg(
        q(F.sum("bought")).alias("buy_vol"), q(F.sum("sold")).alias("sell_vol"), F.sum("buys").alias("buy_count"), F.sum("sells").alias("sell_count")
    )


def footprints(trades: DataFrame, seconds: int) -> DataFrame:
    """One row per bar, its levels as a map."""
    return footprint_levels(trades, seconds).groupBy("symbol", "bar_ts").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("level").cast("string"), F.struct("buy_vol", "sell_vol", "buy_count", "sell_count"))))).alias("price_levels")
    )


def deltas(trades: DataFrame, seconds: int) -> DataFrame:
    """Delta of each bar and its running sum."""
    d = footprint_levels(trades, seconds).groupBy("symbol", "bar_ts").agg(F.sum("buy_vol").alias("buy"), F.sum("sell_vol").alias("sell"))
    d = d.withColumn("delta", q(F.col("buy") - F.col("sell")))
    return K.running_sums(d, ["symbol"], ["bar_ts"], K.day_of("bar_ts"), {"cvd": "delta"}).withColumn("cvd", q("cvd"))


def large_trades(trades: DataFrame, seconds: int, keep: int = 50) -> DataFrame:
    """Trades of large quote size, the last ``keep`` of each bar."""
    t = trades.withColumns({"bar_ts": F.window("ts", f"{seconds} seconds")["start"], "quote": F.col("price") * F.col("qty")})
    big = t.where(F.col("quote") >= large_trade("symbol"))
    nth = F.row_number().over(Window.partitionBy("symbol", "bar_ts").orderBy(F.col("ts").desc(), F.col("trade_id").desc()))
    return big.withColumn("nth", nth).where(F.col("nth") <= keep).select("symbol", "bar_ts", "ts", "price", "qty", q("quote").alias("quote"), F.when(F.col("is_buyer_maker"), "sell").otherwise("buy").alias("side"))


def funding(rows: DataFrame) -> DataFrame:
    """Funding in percent, yearly, and hours to the next."""
    return rows.select("symbol", q(F.col("rate") * 100).alias("rate_pct"), q(F.col("rate") * 3 * 365 * 100, 4).alias("annual_pct"), q((F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("as_of").cast("timestamp"))) / 3.6e9, 2).alias("hours_to_next"))


def change(series: DataFrame, value: str, by: list[str], flat: float = 1.0) -> DataFrame:
    """First, last, change in percent and trend of a series."""
    d = series.groupBy(*by).agg(F.min_by(value, "ts").alias("first"), F.max_by(value, "ts").alias("last"), F.count("*").alias("n"))
    pct = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.col("first") * 100).otherwise(0.0)
    return d.select(*by, "n", q("first").alias("first"), q("last").alias("last"), q(pct, 4).alias("change_pct"), F.when(pct > flat, "rising").when(pct < -flat, "falling").otherwise("flat").alias("trend"))


#: Hours of a positioning period.
PERIOD_HOURS = {"5m": 1 / 12, "15m": 0.25, "30m": 0.5, "1h": 1, "2h": 2, "4h": 4, "6h": 6, "12h": 12, "1d": 24}


def newest_periods(series: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` rows of each symbol."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    return series.withColumn("nth", rank).where(F.col("nth") <= limit).drop("nth")


def tendency(series: DataFrame, value: str, name: str, flat: float = 1.0) -> DataFrame:
    """``symbol`` with count, newest value, change in percent and trend of a series;
    change and trend are null for fewer than two values or a first one of zero."""
    d = series.groupBy("symbol").agg(F.count("*").alias("n"), F.min_by(value, "ts").alias("first"), F.max_by(value, "ts").alias("last"))
    known = (F.col("n") >= 2) & (F.col("first") != 0)
    step = (F.col("last") - F.col("first")) * 100
    pct, move = F.when(known, step / F.col("first")), F.when(known, step / F.abs("first"))
    trend = F.when(move > flat, "rising").when(move < -flat, "falling").when(known, "flat")
    return d.select("symbol", F.col("n").alias(f"{name}_n"), F.col("last").alias(f"{name}_last"), q(pct, 4).alias(f"{name}_change_pct"), trend.alias(f"{name}_trend"))


def derivatives(funding: DataFrame, open_interest: DataFrame | None = None, global_ratio: DataFrame | None = None, top_ratio: DataFrame | None = None, taker: DataFrame | None = None, period: str = "1h", limit: int = 24) -> dict[str, DataFrame]:
    """Positioning: ``summary``, a row for each symbol of ``funding(symbol, mark_price,
    rate, next_ts, as_of)``, and ``series``, the newest 12 values of each series.

    The other inputs are series by ``symbol, ts``: ``oi, oi_value`` and ``ratio``; each
    is cut to its newest ``limit`` rows, and one that is missing leaves nulls.
    """
    given = {"open_interest": (open_interest, "oi"), "global": (global_ratio, "ratio"), "top_trader": (top_ratio, "ratio"), "taker": (taker, "ratio")}
    hours_to = (F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("as_of").cast("timestamp"))) / 3.6e9
    out = funding.select("symbol", "mark_price", "rate", q(F.col("rate") * 100, 5).alias("rate_pct"), q(F.col("rate") * 3 * 365 * 100, 3).alias("annualized_pct"), q(hours_to, 2).alias("next_funding_in_hours"))
    parts = None
    for name, (series, value) in given.items():
        if series is None:
            empty = {"n": "long", "last": "double", "change_pct": "double", "trend": "string"}
            out = out.withColumns({f"{name}_{c}": F.lit(None).cast(t) for c, t in empty.items()})
            continue
        cut = newest_periods(series, limit)
        out = out.join(tendency(cut, value, name), "symbol", "left")
        if name == "open_interest":
            out = out.join(cut.groupBy("symbol").agg(F.max_by("oi_value", "ts").alias("oi_value")), "symbol", "left")
        if name != "top_trader":
            part = newest_periods(cut, 12).select("symbol", F.lit(name).alias("series"), "ts", F.col(value).cast("double").alias("value"))
            parts = part if parts is None else parts.unionByName(part)
    if open_interest is None:
        out = out.withColumn("oi_value", F.lit(None).cast("double"))
    hours = q(F.lit(float(PERIOD_HOURS[period])) * F.greatest(F.coalesce("open_interest_n", F.lit(1)), F.lit(1)), 2)
    summary = out.select(
        "symbol", "mark_price", F.lit(period).alias("period"), F.lit(limit).alias("limit"), hours.alias("hours"), "rate", "rate_pct", "annualized_pct", "next_funding_in_hours",
        F.col("open_interest_last").alias("open_interest"), "oi_value", F.col("open_interest_change_pct").alias("oi_change_pct"), F.col("open_interest_trend").alias("oi_trend"),
        F.col("global_last").alias("global_ratio"), "global_trend", F.col("top_trader_last").alias("top_trader_ratio"), "top_trader_trend", F.col("taker_last").alias("taker_ratio"), "taker_trend",
    )
    none = funding.select("symbol", F.lit("").alias("series"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("double").alias("value")).where("false")
    return {"summary": summary, "series": none if parts is None else parts}


def position_size(requests: DataFrame, atr: Column | None = None, atr_mult: float = 1.5) -> DataFrame:
    """Units, notional, margin and reward to risk of each request, or its error.
    A missing stop is set from ``atr`` where that is given."""
    stop = F.col("stop")
    if atr is not None:
        stop = F.coalesce(stop, F.when(F.coalesce("side", F.lit("long")) == "short", F.col("entry") + atr * atr_mult).otherwise(F.col("entry") - atr * atr_mult))
    e, target = F.col("entry"), F.col("target")
    side = F.coalesce("side", F.when(stop < e, "long").when(stop > e, "short"), F.when(target > e, "long").when(target < e, "short"), F.lit("long"))
    error = (
        F.when(~(F.col("equity") > 0), "equity must be positive").when(~((F.col("risk_pct") > 0) & (F.col("risk_pct") <= 100)), "risk_pct must be within 0 and 100")
        .when(~(e > 0), "entry must be positive").when(stop.isNull() | ~(stop > 0), "stop must be positive").when(stop == e, "stop equals entry")
        .when((side == "long") & (stop > e), "stop is on the wrong side").when((side == "short") & (stop < e), "stop is on the wrong side")
    )
    risk = F.col("equity") * F.col("risk_pct") / 100
    distance = F.abs(e - stop)
    units = F.try_divide(risk, distance)
    rr = F.try_divide(F.abs(target - e), distance)
    ok = lambda c: F.when(error.isNull(), c)
    return requests.select(
        "request_id", ok(side).alias("side"), ok(q(risk, 4)).alias("risk"), ok(q(units)).alias("units"), ok(q(units * e, 4)).alias("notional"), ok(q(units * e / F.col("leverage"), 4)).alias("margin"),
        ok(q(rr, 4)).alias("rr"), ok(q(F.try_divide(F.lit(100.0), 1 + rr), 4)).alias("breakeven_pct"), error.alias("error"),
    )


#: Windows of the day in minutes, by start and end.
CLOCK = (("asia", 0, 480), ("london", 480, 780), ("new_york", 780, 1260))
KILLZONES = (("London Silver Bullet", 420, 480), ("London Open", 420, 540), ("NY Open", 720, 840), ("NY AM Silver Bullet", 840, 900), ("NY PM Silver Bullet", 1080, 1140))


def session_clock(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Where each time stands in the trading day."""
    m = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60.0
    current, into, after, wait = F.lit("post_ny"), F.lit(None), F.lit("asia"), F.lit(1440) - m
    for i, (name, start, end) in enumerate(CLOCK):
        inside = (m >= start) & (m < end)
        third = F.floor((m - start) / ((end - start) / 3.0))
        into = F.when(inside, F.when(third < 1, "early").when(third < 2, "middle").otherwise("late")).otherwise(into)
        current = F.when(inside, name).otherwise(current)
        following = CLOCK[i + 1] if i + 1 < len(CLOCK) else None
        after = F.when(inside, following[0] if following else "asia").otherwise(after)
        wait = F.when(inside, (following[1] if following else 1440) - m).otherwise(wait)
    active, coming, coming_in = F.lit(None).cast("string"), F.lit(KILLZONES[0][0]), F.lit(1440 + KILLZONES[0][1]) - m
    for name, start, end in reversed(KILLZONES):
        active = F.when((m >= start) & (m < end), name).otherwise(active)
        coming = F.when(m < start, name).otherwise(coming)
        coming_in = F.when(m < start, start - m).otherwise(coming_in)
    return rows.select(*rows.columns, current.alias("session"), into.alias("phase"), after.alias("next_session"), F.floor(wait + 0.5).alias("next_in"), active.alias("killzone"), coming.alias("next_killzone"), F.floor(coming_in + 0.5).alias("killzone_in"))
