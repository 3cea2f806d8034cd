"""The registered queries: operators applied to the market views of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import n_if, q, rate
from ..operators import bars as B
from ..operators import indicators as I
from ..operators import sessions as S
from ..sources import market as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def bars(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    return B.resample(M.ticks(spark, sf_dir), seconds)


def indexed(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    return B.indexed(bars(spark, sf_dir, seconds))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.daily(M.daily_trades(spark, sf_dir))


@query
def a13_bars_1h(spark, sf_dir):
    return bars(spark, sf_dir, 3600)


@query
def a13_bars_5m(spark, sf_dir):
    return bars(spark, sf_dir, 300)


@query
def a13_bars_daily(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.withColumn("volume", q("volume", 4))


@query
def a11_latest_bars(spark, sf_dir):
    out = B.latest(bars(spark, sf_dir, 900), 200)
    return out.withColumn("iso", F.date_format("bar_ts", "yyyy-MM-dd'T'HH:mm:ss"))


@query
def a02_range_scan(spark, sf_dir):
    b = bars(spark, sf_dir, 3600)
    return M.scan(b.union(b), start=F.lit("2024-01-05").cast("timestamp_ntz"), end=F.lit("2024-01-12").cast("timestamp_ntz"), limit=100)


@query
def a05_venue(spark, sf_dir):
    n = M.table(spark, sf_dir, "nation")
    named = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.substring("n_name", 1, 3), F.lit("_USD"))).otherwise(F.concat("n_name", F.lit("USDT"))).alias("symbol"))
    return named.withColumn("venue", M.venue())


@query
def a06_trade_scan(spark, sf_dir):
    t = M.ticks(spark, sf_dir).where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") <= F.lit("2024-01-11").cast("timestamp_ntz")))
    return t.select("symbol", "ts", "trade_id", "price", "qty", "is_buyer_maker")


@query
def b01_geometry(spark, sf_dir):
    size, body = F.col("high") - F.col("low"), F.abs(F.col("close") - F.col("open"))
    return bars(spark, sf_dir, 3600).select(
        "symbol", "bar_ts", q(body).alias("body"), q(size).alias("range"),
        q(F.col("high") - F.greatest("open", "close")).alias("upper_wick"), q(F.least("open", "close") - F.col("low")).alias("lower_wick"),
        (F.col("close") > F.col("open")).alias("bull"), F.when(size > 0, q(body / size)).otherwise(0.0).alias("body_ratio"),
    )


@query
def b06_sessions(spark, sf_dir):
    return S.in_sessions(bars(spark, sf_dir, 3600)).groupBy("symbol", "session").agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"))


@query
def c01_align(spark, sf_dir):
    return B.aligned(bars(spark, sf_dir, 3600), ["click", "error", "purchase", "signup", "view"])


@query
def c03_asof_daily(spark, sf_dir):
    from ..operators.asof import asof_join

    days = S.calendar_days(bars(spark, sf_dir, 3600)).select("symbol", F.col("day").cast("timestamp_ntz").alias("ts"), "d_close")
    trades = M.ticks(spark, sf_dir).select("symbol", "ts", "trade_id", "price")
    return asof_join(trades, days, by=["symbol"], on="ts", strict=True)


@query
def d01_session_range(spark, sf_dir):
    return S.session_ranges(bars(spark, sf_dir, 3600)).withColumn("day", F.col("day").cast("string"))


@query
def d02_calendar_days(spark, sf_dir):
    return S.calendar_days(bars(spark, sf_dir, 3600)).withColumn("day", F.col("day").cast("string"))


@query
def d03_adr(spark, sf_dir):
    return S.average_daily_range(bars(spark, sf_dir, 3600)).withColumn("adr", q("adr"))


@query
def d05_range_distribution(spark, sf_dir):
    from ..functions.scalars import spread

    return S.session_ranges(bars(spark, sf_dir, 3600)).groupBy("session").agg(*spread("range", 7))


@query
def d06_session_summary(spark, sf_dir):
    r = S.session_ranges(bars(spark, sf_dir, 3600))
    return r.groupBy("symbol", "session").agg(
        F.count("*").alias("n"), q(F.avg("range")).alias("avg_range"), q(F.avg((F.col("high") - F.col("low")) / F.col("low") * 100), 3).alias("avg_range_pct"),
        rate(n_if(F.col("direction") == "bullish"), F.count("*")).alias("bullish_pct"),
    )


def sweep_rates(bars: DataFrame, by: list[str]) -> DataFrame:
    """Share of the days with both sessions on which a session swept the one before."""
    r = S.session_ranges(bars).select("symbol", "day", "session", "day_of_week")
    before = r.select("symbol", "day", F.when(F.col("session") == "asia", "london").when(F.col("session") == "london", "new_york").alias("session")).where("session is not null")
    days = r.join(before, ["symbol", "day", "session"])
    s = S.sweeps(bars).drop("day_of_week")
    return days.join(s, ["symbol", "day", "session"], "left").groupBy(*by).agg(
        F.count("*").alias("days"), F.count("swept_side").alias("sweeps"), rate(F.count("swept_side"), F.count("*")).alias("sweep_pct"),
        rate(n_if(F.col("swept_side") == "high"), F.count("swept_side")).alias("high_pct"), rate(n_if(F.col("swept_side") == "low"), F.count("swept_side")).alias("low_pct"),
        rate(n_if(F.col("swept_side") == "both"), F.count("swept_side")).alias("both_pct"), rate(n_if(F.col("reversal")), F.count("swept_side")).alias("reversal_pct"),
        q(F.avg("reversal_distance"), 4).alias("avg_distance"),
    )


@query
def d07_sweep_rates(spark, sf_dir):
    return sweep_rates(bars(spark, sf_dir, 3600), ["symbol", "session"])


@query
def d08_ny_continuation(spark, sf_dir):
    c = S.continuations(bars(spark, sf_dir, 3600))
    return c.groupBy("symbol").agg(F.count("*").alias("days"), n_if(F.col("continuation")).alias("continued"), rate(n_if(F.col("continuation")), F.count("*")).alias("continuation_pct"), q(F.avg("ny_range")).alias("avg_ny_range"))


@query
def d09_power_of_three(spark, sf_dir):
    b = bars(spark, sf_dir, 3600)
    days = S.day_rows(b).groupBy("symbol").agg(F.count("*").alias("days"))
    p = S.power_of_three(b).groupBy("symbol").agg(F.count("*").alias("n"), n_if(F.col("success")).alias("succeeded"), q(F.avg("distribution_distance"), 4).alias("avg_distance"))
    out = days.join(p, "symbol", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "succeeded": F.coalesce("succeeded", F.lit(0))})
    return out.select("symbol", "days", "n", "succeeded", rate("n", "days").alias("occurrence_pct"), rate("succeeded", "n").alias("success_pct"), "avg_distance")


@query
def d10_weekday_sweeps(spark, sf_dir):
    return sweep_rates(bars(spark, sf_dir, 3600), ["session", "day_of_week"])


@query
def e01_true_range(spark, sf_dir):
    return I.true_range(indexed(spark, sf_dir, 3600)).select("symbol", "bar_ts", "tr")


@query
def e02_atr(spark, sf_dir):
    return I.atr(indexed(spark, sf_dir, 3600), 14).select("symbol", "bar_ts", "atr")


@query
def e03_atr_entry(spark, sf_dir):
    return I.atr_at_entry(indexed(spark, sf_dir, 3600), 14).select("symbol", "bar_ts", "atr_entry")


@query
def e04_wilder(spark, sf_dir):
    return I.wilder_atr(indexed(spark, sf_dir, 3600), 200)


@query
def e05_log_returns(spark, sf_dir):
    return I.log_returns(indexed(spark, sf_dir, 3600)).select("symbol", "bar_ts", q("log_return", 9).alias("log_return"))


@query
def e06_realized_vol(spark, sf_dir):
    return I.realized_vol(indexed(spark, sf_dir, 3600), 30, I.PER_YEAR["1h"]).select("symbol", "bar_ts", "realized_vol")


@query
def e07_band_width(spark, sf_dir):
    return I.band_width(indexed(spark, sf_dir, 3600)).select("symbol", "bar_ts", "width")


@query
def e08_squeeze(spark, sf_dir):
    return I.squeeze(indexed(spark, sf_dir, 3600)).select("symbol", "bar_ts", "squeeze_pct")


@query
def e14_prior_median(spark, sf_dir):
    d = S.calendar_days(bars(spark, sf_dir, 3600)).withColumn("size", F.col("d_high") - F.col("d_low"))
    return d.select("symbol", F.col("day").cast("string").alias("day"), q(I.prior_median(d, "size")).alias("prior_median"))


@query
def e16_adr_used(spark, sf_dir):
    return I.adr_used(S.day_rows(bars(spark, sf_dir, 3600)), 14).withColumn("day", F.col("day").cast("string"))


@query
def vol01_state(spark, sf_dir):
    return I.volatility_state(indexed(spark, sf_dir, 3600), I.PER_YEAR["1h"])


@query
def cor01_matrix(spark, sf_dir):
    return I.correlations(bars(spark, sf_dir, 3600))


@query
def cor02_base(spark, sf_dir):
    return I.base_read(bars(spark, sf_dir, 3600), "click")


@query
def d31_summary(spark, sf_dir):
    return B.recent_summary(bars(spark, sf_dir, 3600), 20)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


@query
def ses01_sweeps(spark, sf_dir):
    return _dated(S.sweeps(bars(spark, sf_dir, 3600)))


@query
def ses02_continuation(spark, sf_dir):
    return _dated(S.continuations(bars(spark, sf_dir, 3600)))


@query
def ses03_power_of_three(spark, sf_dir):
    return _dated(S.power_of_three(bars(spark, sf_dir, 3600)))


@query
def pdh01_touch(spark, sf_dir):
    return _dated(S.prior_day_touch(bars(spark, sf_dir, 3600)))


@query
def d14_prior_day(spark, sf_dir):
    p = S.prior_day_touch(bars(spark, sf_dir, 3600))
    n, up, down = F.count("*"), n_if(F.col("touched_pdh")), n_if(F.col("touched_pdl"))
    return p.groupBy("symbol").agg(
        n.alias("days"), rate(up, n).alias("pdh_pct"), rate(down, n).alias("pdl_pct"), rate(n_if(F.col("outcome") == "both"), n).alias("both_pct"),
        rate(n_if(F.col("outcome") == "neither"), n).alias("neither_pct"), rate(n_if(F.col("pdh_reversal")), up).alias("pdh_reversal_pct"),
        rate(n_if(F.col("pdh_held")), up).alias("pdh_held_pct"), rate(n_if(F.col("pdl_reversal")), down).alias("pdl_reversal_pct"), rate(n_if(F.col("pdl_held")), down).alias("pdl_held_pct"),
    )


@query
def ib01_days(spark, sf_dir):
    return _dated(S.initial_balance(bars(spark, sf_dir, 300), bars(spark, sf_dir, 3600)))


@query
def d15_initial_balance(spark, sf_dir):
    d, n = S.initial_balance(bars(spark, sf_dir, 300), bars(spark, sf_dir, 3600)), F.count("*")
    return d.groupBy("day_of_week").agg(
        n.alias("days"), *[rate(n_if(F.col("outcome") == o), n).alias(f"{o}_pct") for o in ("only_h", "only_l", "both", "neither")],
        rate(n_if(F.col("day_direction") == "long"), n).alias("long_pct"), q(F.avg("max_extension"), 4).alias("avg_extension"), q(F.percentile("ib_size", F.lit(0.5)), 4).alias("median_size"),
    )


@query
def orb01_days(spark, sf_dir):
    return _dated(S.opening_range(bars(spark, sf_dir, 300)))


@query
def d16_opening_range(spark, sf_dir):
    from ..functions.scalars import spread

    d, n = S.opening_range(bars(spark, sf_dir, 300)), F.count("*")
    d = d.withColumn("up_multiple", F.when(F.col("orb_size") > 0, q(F.col("up_extension") / F.col("orb_size"), 4)))
    return d.groupBy("day_of_week").agg(n.alias("days"), *[rate(n_if(F.col("outcome") == o), n).alias(f"{o}_pct") for o in ("only_h", "only_l", "both", "neither")], *spread("up_multiple", 6, "up_"))


@query
def ext01_days(spark, sf_dir):
    return _dated(S.day_summaries(bars(spark, sf_dir, 3600)))


@query
def ext02_breakouts(spark, sf_dir):
    return _dated(S.breakouts(bars(spark, sf_dir, 3600)))


@query
def d19_extension_grid(spark, sf_dir):
    b, n = S.breakouts(bars(spark, sf_dir, 3600)), F.count("*")
    return b.groupBy("session").agg(
        n.alias("days"), *[rate(n_if(F.col("cell") == c), n).alias(f"{c}_pct") for c in ("only_h", "only_l", "both", "neither")],
        n_if(F.col("sequence") == "h_then_l").alias("h_then_l"), n_if(F.col("sequence") == "l_then_h").alias("l_then_h"),
        q(F.avg("overshoot"), 4).alias("avg_overshoot"), q(F.percentile("overshoot_multiple", F.lit(0.5)), 4).alias("median_multiple"),
    )


@query
def d21_day_direction(spark, sf_dir):
    d, n = S.day_summaries(bars(spark, sf_dir, 3600)), F.count("*")
    return d.groupBy("symbol").agg(n.alias("days"), rate(n_if(F.col("direction") == "long"), n).alias("long_pct"), q(F.avg("up_leg"), 4).alias("avg_up"), q(F.avg("down_leg"), 4).alias("avg_down"))


@query
def d22_hod_lod(spark, sf_dir):
    d = S.day_summaries(bars(spark, sf_dir, 3600))
    total = d.groupBy().agg(F.count("*").alias("days"))
    sides = d.select(F.explode(F.array(F.struct(F.lit("hod").alias("side"), F.col("hod_session").alias("session")), F.struct(F.lit("lod").alias("side"), F.col("lod_session").alias("session")))).alias("x"))
    counts = sides.groupBy(F.col("x.session").alias("session")).agg(n_if(F.col("x.side") == "hod").alias("hod"), n_if(F.col("x.side") == "lod").alias("lod"))
    return counts.crossJoin(F.broadcast(total)).select("session", "hod", "lod", rate("hod", "days").alias("hod_pct"), rate("lod", "days").alias("lod_pct"))


@query
def pk01_days(spark, sf_dir):
    return _dated(S.peak_points(bars(spark, sf_dir, 3600)))


@query
def d24_peak_matrix(spark, sf_dir):
    p = S.peak_points(bars(spark, sf_dir, 3600))
    return p.groupingSets([["hod_session", "lod_session"], ["hod_session"], ["lod_session"], []], "hod_session", "lod_session").agg(F.count("*").alias("n"), n_if(F.col("net_direction") == "bullish").alias("bullish"))


@query
def d25_timing(spark, sf_dir):
    days = S.day_summaries(bars(spark, sf_dir, 3600)).select("symbol", "day", "direction")
    r = S.session_ranges(bars(spark, sf_dir, 3600)).drop("direction").join(days, ["symbol", "day"])
    hour = F.substring("high_time", 1, 2).cast("int")
    p = F.percentile(hour, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return r.groupBy("session", "direction").agg(F.count("*").alias("n"), p[0].alias("p25_hour"), p[1].alias("median_hour"), p[2].alias("p75_hour"))


@query
def d32_average_time(spark, sf_dir):
    from ..functions.scalars import clock, minutes

    p = S.prior_day_touch(bars(spark, sf_dir, 900)).where("touched_pdh")
    m = F.substring("pdh_touch_time", 1, 2).cast("int") * 60 + F.substring("pdh_touch_time", 4, 2).cast("int")
    return p.groupBy("symbol").agg(F.count("*").alias("n"), clock(F.avg(m)).alias("avg_time"))


@query
def dt01_days(spark, sf_dir):
    return _dated(S.day_types(bars(spark, sf_dir, 3600)))


@query
def d18_day_types(spark, sf_dir):
    """Every archetype, also those that never occur; the weekday it falls on most."""
    d = S.day_types(bars(spark, sf_dir, 3600))
    dim = spark.createDataFrame(list(S.REGIMES.items()), "archetype string, regime string")
    by_day = d.groupBy("archetype", "day_of_week").agg(F.count("*").alias("k"), F.min("day").alias("first_day"))
    top = by_day.groupBy("archetype").agg(F.min_by("day_of_week", F.struct(-F.col("k"), "first_day")).alias("top_weekday"), F.sum("k").alias("n"))
    total = d.groupBy().agg(F.count("*").alias("days"))
    out = dim.join(top, "archetype", "left").crossJoin(F.broadcast(total))
    return out.select("archetype", "regime", F.coalesce("n", F.lit(0)).alias("n"), rate(F.coalesce("n", F.lit(0)), "days").alias("pct"), "top_weekday")


# ---- patterns, bias, concepts, levels -----------------------------------------------------------

from ..operators import bias as A  # noqa: E402
from ..operators import candles as C  # noqa: E402
from ..operators import outcomes as O  # noqa: E402
from ..operators import structure as T  # noqa: E402


@query
def pa01_single(spark, sf_dir):
    return C.patterns(indexed(spark, sf_dir, 3600), (1,))


@query
def pa02_double(spark, sf_dir):
    return C.patterns(indexed(spark, sf_dir, 3600), (2,))


@query
def pa03_triple(spark, sf_dir):
    return C.patterns(indexed(spark, sf_dir, 300), (3,))


@query
def pa04_counts(spark, sf_dir):
    return C.patterns(indexed(spark, sf_dir, 900)).groupBy("pattern", "span").agg(F.count("*").alias("n"), F.max("bar_ts").alias("newest"))


@query
def bias01_daily(spark, sf_dir):
    return _dated(A.bias_entries(daily(spark, sf_dir)))


@query
def bias01_weekly(spark, sf_dir):
    return _dated(A.bias_entries(daily(spark, sf_dir), "W"))


@query
def d29_bias_statistics(spark, sf_dir):
    return A.bias_statistics(A.bias_entries(daily(spark, sf_dir)))


@query
def ict01_draw(spark, sf_dir):
    return _dated(A.draw_on_liquidity(bars(spark, sf_dir, 3600)))


@query
def ict02_phases(spark, sf_dir):
    return _dated(A.phases(bars(spark, sf_dir, 3600)))


@query
def ict03_judas(spark, sf_dir):
    return _dated(A.judas_swings(bars(spark, sf_dir, 3600)))


@query
def ict04_session_bias(spark, sf_dir):
    return _dated(A.session_biases(bars(spark, sf_dir, 3600)))


@query
def lvl01_levels(spark, sf_dir):
    return A.period_levels(bars(spark, sf_dir, 900))


# ---- structure ----------------------------------------------------------------------------------


def series(spark, sf_dir, seconds: int = 900) -> T.Series:
    return T.of(indexed(spark, sf_dir, seconds))


@query
def smc01_pivots(spark, sf_dir):
    s = series(spark, sf_dir)
    return T.pivots(s, 20).withColumn("k", F.lit(20)).unionByName(T.pivots(s, 5).withColumn("k", F.lit(5)))


@query
def smc02_structure(spark, sf_dir):
    return T.structures(series(spark, sf_dir), 20, 5)


@query
def smc02_trend(spark, sf_dir):
    return T.trend(series(spark, sf_dir), 5)


@query
def smc03_gaps(spark, sf_dir):
    return T.gaps(series(spark, sf_dir))


@query
def smc04_order_blocks(spark, sf_dir):
    return T.order_blocks(series(spark, sf_dir), 20, 5)


@query
def smc05_equal_levels(spark, sf_dir):
    return T.equal_levels(series(spark, sf_dir), 20).withColumn("level", q("level"))


@query
def smc06_swing_labels(spark, sf_dir):
    return T.swing_labels(series(spark, sf_dir), 20)


@query
def smc07_fractals(spark, sf_dir):
    return T.fractals(series(spark, sf_dir))


@query
def smc08_sweeps(spark, sf_dir):
    return T.liquidity_sweeps(series(spark, sf_dir), 5)


@query
def smc09_sweep_areas(spark, sf_dir):
    return T.sweep_areas(series(spark, sf_dir), 5)


@query
def smc10_breakers(spark, sf_dir):
    return T.breaker_blocks(series(spark, sf_dir), 20, 5)


@query
def smc11_trends(spark, sf_dir):
    return T.candle_trends(series(spark, sf_dir), 5)


@query
def smc12_range(spark, sf_dir):
    return T.trading_range(series(spark, sf_dir), 20, 5)


def smc_outcomes(spark, sf_dir) -> DataFrame:
    return O.evaluated(indexed(spark, sf_dir, 3600))


def flags_as_text(o: DataFrame) -> DataFrame:
    flags = {c: F.col(c).cast("string") for c in ("retested", "held", "filled", "swept", "success")}
    return o.withColumns(flags | {c: F.col(c).cast("double") for c in ("retested_within", "filled_within")})


@query
def smc15_outcomes(spark, sf_dir):
    return flags_as_text(smc_outcomes(spark, sf_dir))


@query
def d11_smc_statistics(spark, sf_dir):
    return O.summary(smc_outcomes(spark, sf_dir))


# ---- profile ------------------------------------------------------------------------------------

from ..operators import backtest as X  # noqa: E402
from ..operators import confluence as N  # noqa: E402
from ..operators import flow as W  # noqa: E402
from ..operators import profile as P  # noqa: E402


def recent_sessions(spark, sf_dir) -> DataFrame:
    return P.recent_sessions(bars(spark, sf_dir, 900), "15m", 10)


@query
def tpo02_tick(spark, sf_dir):
    return P.ticks(recent_sessions(spark, sf_dir), ["symbol", "sess"])


@query
def tpo03_rows(spark, sf_dir):
    r = P.price_rows(recent_sessions(spark, sf_dir), ["symbol", "sess"], letters=True)
    return r.select("symbol", "sess", "j", "price", F.col("count").alias("n"), F.concat_ws("", "letters").alias("letters"))


@query
def tpo05_zones(spark, sf_dir):
    return P.zones(recent_sessions(spark, sf_dir), ["symbol", "sess"]).withColumnRenamed("count", "n")


@query
def tpo06_value_area(spark, sf_dir):
    return P.profiles(recent_sessions(spark, sf_dir), ["symbol", "sess"])


@query
def tpo06_value_area_5m(spark, sf_dir):
    return P.profiles(P.recent_sessions(bars(spark, sf_dir, 300), "5m", 10), ["symbol", "sess"])


@query
def eth01_touches(spark, sf_dir):
    return _dated(P.prior_profile_touches(bars(spark, sf_dir, 900), bars(spark, sf_dir, 3600)).drop("rth_range"))


@query
def d17_touch_rates(spark, sf_dir):
    t, n = P.prior_profile_touches(bars(spark, sf_dir, 900), bars(spark, sf_dir, 3600)), F.count("*")
    return t.groupBy("symbol").agg(n.alias("days"), *[rate(n_if(F.col(f"touched_{x}")), n).alias(f"{x}_pct") for x in ("poc", "vah", "val")])


# ---- flow ---------------------------------------------------------------------------------------


@query
def of01_levels(spark, sf_dir):
    return W.footprint_levels(M.ticks(spark, sf_dir), 3600)


@query
def of01_footprint_map(spark, sf_dir):
    f = W.footprints(M.ticks(spark, sf_dir), 3600)
    return f.select("symbol", "bar_ts", F.size("price_levels").alias("levels"), q(F.aggregate(F.map_values("price_levels"), F.lit(0.0), lambda a, x: a + x["buy_vol"])).alias("buy"))


@query
def of02_delta(spark, sf_dir):
    return W.deltas(M.ticks(spark, sf_dir), 3600)


@query
def of03_large(spark, sf_dir):
    return W.large_trades(M.ticks(spark, sf_dir), 3600)


@query
def of04_last_bars(spark, sf_dir):
    """The last 12 bars before a point in time, with what of the first is missing."""
    t = M.ticks(spark, sf_dir)
    as_of = F.lit("2024-01-20 10:30:00").cast("timestamp_ntz")
    start = F.date_trunc("hour", as_of) - F.expr("interval 11 hours")
    return W.deltas(t.where((F.col("ts") >= start) & (F.col("ts") <= as_of)), 3600).withColumn("truncated", F.col("bar_ts") == F.date_trunc("hour", as_of))


@query
def drv01_funding(spark, sf_dir):
    n = M.table(spark, sf_dir, "nation")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = n.select(F.col("n_name").alias("symbol"), ((F.col("n_nationkey") - 12) / 10000.0).alias("rate"), (base + F.make_dt_interval(F.lit(0), F.col("n_nationkey"))).alias("as_of"), (base + F.make_dt_interval(F.lit(1), F.lit(8))).alias("next_ts"))
    return W.funding(rows)


@query
def drv02_changes(spark, sf_dir):
    p = M.positioning(spark, sf_dir).withColumn("month", F.date_trunc("month", "ts"))
    out = None
    for name in ("oi", "ratio", "buy_vol"):
        one = W.change(p, name, ["month"]).withColumn("series", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def pos01_sizes(spark, sf_dir):
    return W.position_size(M.requests(spark, sf_dir))


@query
def clk01_clock(spark, sf_dir):
    return W.session_clock(M.table(spark, sf_dir, "events").select("event_id", "ts"))


# ---- events, trades, edges ----------------------------------------------------------------------


def all_events(spark, sf_dir) -> DataFrame:
    return X.session_events(bars(spark, sf_dir, 3600)).unionByName(X.smc_events(indexed(spark, sf_dir, 3600)))


@query
def evt01_events(spark, sf_dir):
    return _dated(X.session_events(bars(spark, sf_dir, 3600)))


@query
def bt01_backtest(spark, sf_dir):
    return X.frequencies(all_events(spark, sf_dir))


@query
def bt01_filtered(spark, sf_dir):
    return X.frequencies(X.matching(all_events(spark, sf_dir), session="london", day_of_week="Tuesday"))


@query
def d13_weekdays(spark, sf_dir):
    return X.frequencies(X.session_events(bars(spark, sf_dir, 3600)), "day_of_week")


def simulated(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir, 3600)
    return X.trades(b, X.session_events(b))


@query
def rr03_trades(spark, sf_dir):
    t = _dated(simulated(spark, sf_dir))
    return t.withColumns({c: F.col(c).cast("double") for c in ("bar_idx", "bars_held")})


@query
def rr04_skips(spark, sf_dir):
    t = simulated(spark, sf_dir)
    return t.groupBy("event_type", F.coalesce("skip", F.lit("traded")).alias("reason")).agg(F.count("*").alias("n"))


@query
def d28_equity(spark, sf_dir):
    return X.equity(simulated(spark, sf_dir), ["symbol", "event_type"])


@query
def e24_downsampled(spark, sf_dir):
    return X.downsampled(simulated(spark, sf_dir), ["symbol"], 50)


@query
def edg01_edges(spark, sf_dir):
    return X.edges(all_events(spark, sf_dir)).withColumn("filters", F.to_json("filters"))


@query
def d23_session_card(spark, sf_dir):
    b = bars(spark, sf_dir, 3600)
    r = S.session_ranges(b).select("symbol", "day", "session").join(S.day_summaries(b), ["symbol", "day"])
    n = F.count("*")
    is_hod, is_lod = F.col("hod_session") == F.col("session"), F.col("lod_session") == F.col("session")
    return r.groupBy("symbol", "session").agg(
        n.alias("n"), rate(n_if(F.col("direction") == "long"), n).alias("long_pct"), rate(n_if(is_hod), n).alias("hod_pct"), rate(n_if(is_lod), n).alias("lod_pct"),
        rate(n_if(is_hod & is_lod), n).alias("both_pct"), rate(n_if(~is_hod & ~is_lod), n).alias("neither_pct"),
    )


@query
def d26_forecast(spark, sf_dir):
    """What each session's history says about its next one."""
    b = bars(spark, sf_dir, 3600)
    r = S.session_ranges(b)
    p = F.percentile("range_pct", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    n = F.count("*")
    own = r.groupBy("symbol", "session").agg(n.alias("n"), q(p[0], 6).alias("low_pct"), q(p[1], 6).alias("median_pct"), q(p[2], 6).alias("high_pct"), rate(n_if(F.col("direction") == "bullish"), n).alias("bullish_pct"))
    prior = r.select("symbol", F.when(F.col("session") == "asia", "london").when(F.col("session") == "london", "new_york").alias("session")).where("session is not null").groupBy("symbol", "session").agg(n.alias("prior_days"))
    high, low = n_if(F.col("swept_side").isin("high", "both")), n_if(F.col("swept_side").isin("low", "both"))
    s = S.sweeps(b).groupBy("symbol", "session").agg(n.alias("sweeps"), F.when(high > low, "high").when(low > high, "low").otherwise("either").alias("likely_side"))
    last = b.groupBy("symbol").agg(F.max_by("close", "bar_ts").alias("price"))
    j = own.join(prior, ["symbol", "session"], "left").join(s, ["symbol", "session"], "left").join(last, "symbol")
    half = F.col("price") * F.col("median_pct") / 100.0 / 2.0
    return j.select("symbol", "session", "n", "low_pct", "median_pct", "high_pct", "bullish_pct", rate(F.coalesce("sweeps", F.lit(0)), F.coalesce("prior_days", F.lit(0))).alias("sweep_pct"), "likely_side", q(F.col("price") + half).alias("projected_high"), q(F.col("price") - half).alias("projected_low"))


# ---- confluence ---------------------------------------------------------------------------------


def graded(spark, sf_dir, near: float) -> DataFrame:
    h1 = B.indexed(B.latest(bars(spark, sf_dir, 3600), 300))
    h4 = B.indexed(B.latest(bars(spark, sf_dir, 14400), 300))
    return N.grades(h1, h4, near=near)


@query
def cnf01_grades(spark, sf_dir):
    return graded(spark, sf_dir, 0.5)


@query
def cnf01_grades_wide(spark, sf_dir):
    """The same score with a wide entry zone, so that all factors come into play."""
    return graded(spark, sf_dir, 60.0)


@query
def scan01_ranking(spark, sf_dir):
    return N.ranked(graded(spark, sf_dir, 60.0)).select("rank", "symbol", "score", "direction", "meets_threshold")
