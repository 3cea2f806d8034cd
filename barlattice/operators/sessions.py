"""Trading sessions and days: ranges, sweeps, continuation, opening ranges.

Bars carry ``day``, ``hour`` and ``session``. What compares a session with the
one before it spreads the earlier extremes over the day's bars by a window on
(symbol, day) and finds first breaks by conditional minima, so every operator
is one shuffle by (symbol, day), which spreads well over a cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SESSIONS, clock, confidence, hhmm, minutes, n_if, over, q, rate, session, spread, weekday

BY_DAY = ("symbol", "day")
#: Short names of sessions in wide rows.
SHORT = {"asia": "asia", "london": "ldn", "new_york": "ny"}


def in_sessions(bars: DataFrame) -> DataFrame:
    """Bars with ``day, hour, session``; bars outside all sessions go."""
    out = bars.withColumns({"day": F.to_date("bar_ts"), "hour": F.hour("bar_ts")})
    return out.withColumn("session", session("hour")).where("session is not null")


def first_of(x, condition: Column, at="bar_ts") -> Column:
    """``x`` where the condition first holds."""
    return F.min_by(x, F.when(condition, F.col(at)))


def last_of(x, condition: Column, at="bar_ts") -> Column:
    return F.max_by(x, F.when(condition, F.col(at)))


def session_ranges(bars: DataFrame) -> DataFrame:
    """One row per symbol, day and session."""
    high_at, low_at = F.min_by("bar_ts", F.struct(-F.col("high"), "bar_ts")), F.min_by("bar_ts", F.struct("low", "bar_ts"))
    out = in_sessions(bars).groupBy("symbol", "day", "session").agg(
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.min_by("open", "bar_ts").alias("open"),
        F.max_by("close", "bar_ts").alias("close"),
        hhmm(high_at).alias("high_time"),
        hhmm(low_at).alias("low_time"),
        F.count("*").alias("n_bars"),
    )
    size = F.col("high") - F.col("low")
    return out.withColumns(
        {
            "range": q(size),
            "range_pct": q(size / F.col("low") * 100, 3),
            "direction": F.when(F.col("close") > F.col("open"), "bullish").otherwise("bearish"),
            "day_of_week": weekday("day"),
        }
    )


def day_rows(bars: DataFrame) -> DataFrame:
    """One wide row per symbol and day: figures of each session, null where it
    has no bars, and of the session hours together."""
    own = []
    for name, short in SHORT.items():
        inside = F.col("session") == name
        own += [
            F.max(F.when(inside, F.col("high"))).alias(f"{short}_high"),
            F.min(F.when(inside, F.col("low"))).alias(f"{short}_low"),
            first_of("open", inside).alias(f"{short}_open"),
            last_of("close", inside).alias(f"{short}_close"),
            hhmm(F.min_by("bar_ts", F.when(inside, F.struct(-F.col("high"), F.col("bar_ts"))))).alias(f"{short}_high_time"),
            hhmm(F.min_by("bar_ts", F.when(inside, F.struct(F.col("low"), F.col("bar_ts"))))).alias(f"{short}_low_time"),
        ]
    both = [F.max("high").alias("day_high"), F.min("low").alias("day_low"), F.min_by("open", "bar_ts").alias("day_open"), F.max_by("close", "bar_ts").alias("day_close")]
    out = in_sessions(bars).groupBy("symbol", "day").agg(*own, *both)
    return out.withColumns({"day_range": F.col("day_high") - F.col("day_low"), "day_of_week": weekday("day")})


def average_daily_range(bars: DataFrame) -> DataFrame:
    """``adr`` per symbol: mean range of the session hours of its days."""
    return day_rows(bars).groupBy("symbol").agg(F.avg("day_range").alias("adr"), F.count("*").alias("days"))


def _against(bars: DataFrame) -> DataFrame:
    """Session bars with the extremes of the session before theirs."""
    w = Window.partitionBy(*BY_DAY)
    extremes = {f"{s}_{k}": f(F.when(F.col("session") == n, F.col(c))).over(w) for n, s in SHORT.items() if n != "new_york" for k, f, c in (("h", F.max, "high"), ("l", F.min, "low"))}
    out = in_sessions(bars).withColumns(extremes)
    earlier = F.col("session") == "london"
    return out.where("session <> 'asia'").withColumns(
        {"prior_high": F.when(earlier, F.col("asia_h")).otherwise(F.col("ldn_h")), "prior_low": F.when(earlier, F.col("asia_l")).otherwise(F.col("ldn_l"))}
    ).where("prior_high is not null")


def sweeps(bars: DataFrame) -> DataFrame:
    """Sessions that broke the range of the one before: side, first breaks,
    whether a breaking bar closed back inside."""
    up, down = F.col("high") > F.col("prior_high"), F.col("low") < F.col("prior_low")
    out = _against(bars).groupBy("symbol", "day", "session").agg(
        F.first("prior_high").alias("prior_high"),
        F.first("prior_low").alias("prior_low"),
        F.min(F.when(up, F.col("bar_ts"))).alias("up_at"),
        F.min(F.when(down, F.col("bar_ts"))).alias("down_at"),
        first_of(F.struct("high", "close"), up).alias("u"),
        first_of(F.struct("low", "close"), down).alias("d"),
    )
    out = out.where("up_at is not null or down_at is not null")
    back_up, back_down = F.coalesce(F.col("u.close") < F.col("prior_high"), F.lit(False)), F.coalesce(F.col("d.close") > F.col("prior_low"), F.lit(False))
    down_last = F.col("down_at").isNotNull() & (F.col("up_at").isNull() | (F.col("down_at") >= F.col("up_at")))
    up_dist, down_dist = F.col("u.high") - F.col("u.close"), F.col("d.close") - F.col("d.low")
    distance = F.when(back_up & back_down, F.when(down_last, down_dist).otherwise(up_dist)).when(back_up, up_dist).when(back_down, down_dist).otherwise(0.0)
    return out.select(
        "symbol", "day", "session",
        F.when(F.col("up_at").isNotNull() & F.col("down_at").isNotNull(), "both").when(F.col("up_at").isNotNull(), "high").otherwise("low").alias("swept_side"),
        (back_up | back_down).alias("reversal"),
        F.when(down_last, F.col("d.low")).otherwise(F.col("u.high")).alias("sweep_price"),
        hhmm(F.when(down_last, F.col("down_at")).otherwise(F.col("up_at"))).alias("sweep_time"),
        q(distance).alias("reversal_distance"),
        weekday("day").alias("day_of_week"),
    )


def _direction(short: str) -> Column:
    return F.when(F.col(f"{short}_close") > F.col(f"{short}_open"), "bullish").otherwise("bearish")


def continuations(bars: DataFrame) -> DataFrame:
    """Whether New York went on in London's direction; days with both sessions."""
    out = day_rows(bars).where("ldn_high is not null and ny_high is not null")
    return out.select(
        "symbol", "day", _direction("ldn").alias("london_direction"), _direction("ny").alias("ny_direction"),
        (_direction("ldn") == _direction("ny")).alias("continuation"),
        q(F.col("ldn_high") - F.col("ldn_low")).alias("london_range"), q(F.col("ny_high") - F.col("ny_low")).alias("ny_range"), "day_of_week",
    )


def power_of_three(bars: DataFrame) -> DataFrame:
    """Tight Asia, swept by London: where the rest of the day went."""
    d = day_rows(bars).where("asia_high is not null and ldn_high is not null").join(average_daily_range(bars).select("symbol", "adr"), "symbol")
    size = F.col("asia_high") - F.col("asia_low")
    d = d.withColumns(
        {
            "asia_range": size,
            "up": F.col("ldn_high") > F.col("asia_high"),
            "down": F.col("ldn_low") < F.col("asia_low"),
            "after_high": F.greatest("ldn_high", "ny_high"),
            "after_low": F.least("ldn_low", "ny_low"),
            "after_close": F.coalesce("ny_close", "ldn_close"),
        }
    ).where("adr > 0 and asia_range < adr * 0.5 and (up or down)")
    bullish = F.when(F.col("up") & F.col("down"), F.col("after_close") > (F.col("asia_high") + F.col("asia_low")) / 2).otherwise(F.col("down"))
    distance = F.when(bullish, F.col("after_high") - F.col("asia_high")).otherwise(F.col("asia_low") - F.col("after_low"))
    return d.select(
        "symbol", "day", q("asia_range").alias("asia_range"), q(F.col("asia_range") / F.col("adr") * 100, 1).alias("asia_pct_of_adr"),
        F.when(F.col("up") & F.col("down"), "both").when(F.col("up"), "high").otherwise("low").alias("manipulation_side"),
        F.when(bullish, "bullish").otherwise("bearish").alias("distribution_direction"),
        q(distance).alias("distribution_distance"), (distance > F.col("asia_range") * 1.5).alias("success"), "day_of_week",
    )


def prior_day_touch(bars: DataFrame) -> DataFrame:
    """Touches of the day before's high and low, and how the day closed on them.
    All 24 hours count; the day before is the day before with bars."""
    dated = bars.withColumn("day", F.to_date("bar_ts"))
    days = dated.groupBy("symbol", "day").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "bar_ts").alias("day_close"))
    w = over("day")
    days = days.withColumns({"pdh": F.lag("h").over(w), "pdl": F.lag("l").over(w)}).where("pdh is not null").drop("h", "l")
    up, down = F.col("high") >= F.col("pdh"), F.col("low") <= F.col("pdl")
    out = dated.join(days, ["symbol", "day"]).groupBy("symbol", "day", "pdh", "pdl", "day_close").agg(
        F.min(F.when(up, F.col("bar_ts"))).alias("up_at"), F.min(F.when(down, F.col("bar_ts"))).alias("down_at")
    )
    hit_up, hit_down = F.col("up_at").isNotNull(), F.col("down_at").isNotNull()
    return out.select(
        "symbol", "day", "pdh", "pdl", "day_close", hit_up.alias("touched_pdh"), hit_down.alias("touched_pdl"),
        F.when(hit_up & hit_down, "both").when(hit_up, "pdh_only").when(hit_down, "pdl_only").otherwise("neither").alias("outcome"),
        hhmm("up_at").alias("pdh_touch_time"), hhmm("down_at").alias("pdl_touch_time"),
        (hit_up & (F.col("day_close") < F.col("pdh"))).alias("pdh_reversal"), (hit_up & (F.col("day_close") >= F.col("pdh"))).alias("pdh_held"),
        (hit_down & (F.col("day_close") > F.col("pdl"))).alias("pdl_reversal"), (hit_down & (F.col("day_close") <= F.col("pdl"))).alias("pdl_held"),
        weekday("day").alias("day_of_week"),
    )


#: Regular-hours conventions, minutes of the UTC day (start of the
#: opening ranges, end of the initial balance, end of the opening range, end of the session).
CONVENTIONS = {
    "synthetic_ny": (810, 870, 825, 1200),
    "nyse": (810, 870, 825, 1200),
    "frankfurt": (420, 480, 435, 930),
    "london": (480, 540, 495, 990),
    "tokyo": (0, 60, 15, 360),
}


def _slices(fine: DataFrame, start: int, end: int, close: int) -> DataFrame:
    out = fine.withColumns({"day": F.to_date("bar_ts"), "minute": minutes("bar_ts")}).where((F.col("minute") >= start) & (F.col("minute") < close))
    return out.withColumn("inside", F.col("minute") < end)


def initial_balance(fine: DataFrame, hourly: DataFrame, convention: str = "synthetic_ny") -> DataFrame:
    """The first hour's range of each day and how it broke: fine bars, or hourly
    ones on days without fine bars in that hour."""
    start, end, _, close = CONVENTIONS[convention]
    parts = [_slices(b, start, end, close).withColumn("source", F.lit(s)) for b, s in ((fine, "5m"), (hourly, "1H"))]
    both = parts[0].unionByName(parts[1])
    w = Window.partitionBy("symbol", "day")
    has_fine = F.max(F.when((F.col("source") == "5m") & F.col("inside"), 1)).over(w)
    used = both.withColumn("has_fine", has_fine).where((F.col("source") == "5m") == F.col("has_fine").isNotNull())
    used = used.withColumns({"ib_high": F.max(F.when(F.col("inside"), F.col("high"))).over(w), "ib_low": F.min(F.when(F.col("inside"), F.col("low"))).over(w)}).where("ib_high is not null")
    after = ~F.col("inside")
    up, down = after & (F.col("high") > F.col("ib_high")), after & (F.col("low") < F.col("ib_low"))
    d = used.groupBy("symbol", "day", "ib_high", "ib_low", "source").agg(
        F.max(F.when(after, F.col("high"))).alias("ph"), F.min(F.when(after, F.col("low"))).alias("pl"),
        F.min(F.when(up, F.col("bar_ts"))).alias("up_at"), F.min(F.when(down, F.col("bar_ts"))).alias("down_at"),
        first_of(F.col("close") >= F.col("open"), up & down).alias("straddle_up"),
        F.min_by("open", "bar_ts").alias("o"), F.max_by("close", "bar_ts").alias("c"), n_if(F.col("inside")).alias("n_ib"), n_if(after).alias("n_after"),
    )
    size = F.col("ib_high") - F.col("ib_low")
    up_ext, down_ext = F.greatest(F.coalesce("ph", "ib_high") - F.col("ib_high"), F.lit(0.0)), F.greatest(F.col("ib_low") - F.coalesce("pl", "ib_low"), F.lit(0.0))
    hit_up, hit_down = F.col("up_at").isNotNull(), F.col("down_at").isNotNull()
    first_at = F.least("up_at", "down_at")
    # a bar that breaks both sides, each for the first time, is judged by its body
    same_bar = F.col("up_at") == F.col("down_at")
    side = F.when(hit_up & hit_down & same_bar, F.when(F.col("straddle_up"), "high").otherwise("low")).when(hit_up & (~hit_down | (F.col("up_at") < F.col("down_at"))), "high").when(hit_down, "low")
    most = F.greatest(up_ext, down_ext)
    return d.select(
        "symbol", "day", "ib_high", "ib_low", q(size).alias("ib_size"), q(size / F.col("ib_low") * 100, 3).alias("ib_size_pct"),
        q(up_ext).alias("up_extension"), q(down_ext).alias("down_extension"), q(most).alias("max_extension"),
        F.when(most > 0, q(size / most, 3)).alias("size_to_extension"),
        F.when(hit_up & hit_down, "both").when(hit_up, "only_h").when(hit_down, "only_l").otherwise("neither").alias("outcome"),
        side.alias("first_break_side"), hhmm(first_at).alias("first_break_time"),
        F.when(F.col("c") >= F.col("o"), "long").otherwise("short").alias("day_direction"), weekday("day").alias("day_of_week"), "source", "n_ib", "n_after",
    )


def opening_range(fine: DataFrame, convention: str = "synthetic_ny", length: int = 15) -> DataFrame:
    """The opening range of each day and how it broke (touching counts)."""
    start, _, _, close = CONVENTIONS[convention]
    w = Window.partitionBy("symbol", "day")
    used = _slices(fine, start, start + length, close)
    used = used.withColumns({"orb_high": F.max(F.when(F.col("inside"), F.col("high"))).over(w), "orb_low": F.min(F.when(F.col("inside"), F.col("low"))).over(w)}).where("orb_high is not null")
    after = ~F.col("inside")
    up, down = after & (F.col("high") >= F.col("orb_high")), after & (F.col("low") <= F.col("orb_low"))
    d = used.groupBy("symbol", "day", "orb_high", "orb_low").agg(
        F.max(F.when(after, F.col("high"))).alias("ph"), F.min(F.when(after, F.col("low"))).alias("pl"),
        F.min(F.when(up, F.col("bar_ts"))).alias("up_at"), F.min(F.when(down, F.col("bar_ts"))).alias("down_at"), n_if(F.col("inside")).alias("n_orb"),
    )
    hit_up, hit_down = F.col("up_at").isNotNull(), F.col("down_at").isNotNull()
    side = F.when(hit_up & (~hit_down | (F.col("up_at") <= F.col("down_at"))), "high").when(hit_down, "low")
    return d.select(
        "symbol", "day", "orb_high", "orb_low", q(F.col("orb_high") - F.col("orb_low")).alias("orb_size"),
        q(F.greatest(F.coalesce("ph", "orb_high") - F.col("orb_high"), F.lit(0.0))).alias("up_extension"),
        q(F.greatest(F.col("orb_low") - F.coalesce("pl", "orb_low"), F.lit(0.0))).alias("down_extension"),
        side.alias("first_break_side"), hhmm(F.least("up_at", "down_at")).alias("first_break_time"),
        F.when(hit_up & hit_down, "both").when(hit_up, "only_h").when(hit_down, "only_l").otherwise("neither").alias("outcome"),
        weekday("day").alias("day_of_week"), "n_orb",
    )


def extremes_by_session(rows: DataFrame) -> DataFrame:
    """Day rows with open, legs, direction and the sessions of high and low."""
    names = list(SHORT.items())
    hod, lod = F.lit(None), F.lit(None)
    for name, short in reversed(names):
        hod = F.when(F.col(f"{short}_high") == F.col("day_high"), name).otherwise(hod)
        lod = F.when(F.col(f"{short}_low") == F.col("day_low"), name).otherwise(lod)
    first = F.coalesce("asia_open", "ldn_open", "ny_open")
    up, down = F.greatest(F.col("day_high") - first, F.lit(0.0)), F.greatest(first - F.col("day_low"), F.lit(0.0))
    return rows.withColumns({"first_open": first, "up_leg": up, "down_leg": down, "direction": F.when(up >= down, "long").otherwise("short"), "hod_session": hod, "lod_session": lod})


def day_summaries(bars: DataFrame) -> DataFrame:
    out = extremes_by_session(day_rows(bars))
    return out.select("symbol", "day", F.col("first_open").alias("day_open"), "day_high", "day_low", q("up_leg").alias("up_leg"), q("down_leg").alias("down_leg"), "direction", "hod_session", "lod_session", "day_of_week")


def breakouts(bars: DataFrame) -> DataFrame:
    """How London and New York extend beyond the session before, and in which order."""
    up, down = F.col("high") > F.col("prior_high"), F.col("low") < F.col("prior_low")
    d = _against(bars).groupBy("symbol", "day", "session", "prior_high", "prior_low").agg(
        F.min(F.when(up, F.col("bar_ts"))).alias("up_at"), F.min(F.when(down, F.col("bar_ts"))).alias("down_at"), F.max("high").alias("h"), F.min("low").alias("l")
    )
    hit_up, hit_down = F.col("up_at").isNotNull(), F.col("down_at").isNotNull()
    beyond = F.greatest(F.col("h") - F.col("prior_high"), F.col("prior_low") - F.col("l"))
    over_ = F.when(hit_up | hit_down, beyond)
    return d.select(
        "symbol", "day", "session",
        F.when(hit_up & hit_down, "both").when(hit_up, "only_h").when(hit_down, "only_l").otherwise("neither").alias("cell"),
        F.when(hit_up & hit_down, F.when(F.col("up_at") <= F.col("down_at"), "h_then_l").otherwise("l_then_h")).alias("sequence"),
        q(over_).alias("overshoot"), q(F.try_divide(over_, F.col("prior_high") - F.col("prior_low")), 4).alias("overshoot_multiple"), weekday("day").alias("day_of_week"),
    )


def peak_points(bars: DataFrame) -> DataFrame:
    """The sessions that hold the day's high and low (ties: the earlier time) and the net direction."""
    r = session_ranges(bars)
    rank = F.when(F.col("session") == "asia", 0).when(F.col("session") == "london", 1).otherwise(2)
    move = F.col("close") - F.col("open")
    return r.groupBy("symbol", "day", "day_of_week").agg(
        F.min_by("session", F.struct(-F.col("high"), F.col("high_time"), rank)).alias("hod_session"),
        F.min_by("session", F.struct(F.col("low"), F.col("low_time"), rank)).alias("lod_session"),
        F.min_by("high_time", F.struct(-F.col("high"), F.col("high_time"), rank)).alias("hod_time"),
        F.min_by("low_time", F.struct(F.col("low"), F.col("low_time"), rank)).alias("lod_time"),
        F.max("high").alias("day_high"), F.min("low").alias("day_low"),
        F.when(F.coalesce(F.max(F.when(move >= 0, move)), F.lit(0.0)) >= F.coalesce(F.max(F.when(move < 0, -move)), F.lit(0.0)), "bullish").otherwise("bearish").alias("net_direction"),
    )


def calendar_days(bars: DataFrame) -> DataFrame:
    """Daily candles over all 24 hours."""
    return bars.groupBy("symbol", F.to_date("bar_ts").alias("day")).agg(
        F.min_by("open", "bar_ts").alias("d_open"), F.max("high").alias("d_high"), F.min("low").alias("d_low"), F.max_by("close", "bar_ts").alias("d_close")
    )


#: Archetypes and the regime of each.
REGIMES = {
    "asia_breakout_continuation": "trend", "london_breakout_continuation": "trend", "ny_breakout_continuation": "trend",
    "asia_high_london_reversal": "london_reverse", "asia_low_london_reversal": "london_reverse",
    "power_of_3_long": "high_volatile", "power_of_3_short": "high_volatile", "double_sweep_expansion": "high_volatile",
    "inside_day": "rare", "outside_day": "rare", "consolidation_drift": "rare",
}


def day_types(bars: DataFrame) -> DataFrame:
    """Each day's archetype, by rules in strict order, and its regime."""
    w = over("day")
    before = over("day").rowsBetween(-30, -1)
    d = calendar_days(bars).withColumn("size", F.col("d_high") - F.col("d_low"))
    d = d.withColumns({"prev_high": F.lag("d_high").over(w), "prev_low": F.lag("d_low").over(w), "n_prior": F.count("size").over(before), "med": F.percentile("size", F.lit(0.5)).over(before)})
    d = d.withColumn("expansion", F.when((F.col("n_prior") >= 5) & (F.col("med") > 0), F.col("size") / F.col("med")).otherwise(1.0))
    s = sweeps(bars)

    def swept(name: str, prefix: str) -> DataFrame:
        return s.where(F.col("session") == name).select("symbol", "day", F.col("swept_side").alias(f"{prefix}_side"), F.col("reversal").alias(f"{prefix}_rev"))

    p3 = power_of_three(bars).select("symbol", "day", F.col("distribution_direction").alias("p3_dir"), F.col("manipulation_side").alias("p3_side"))
    keys = ["symbol", "day"]
    rows = day_rows(bars).drop("day_high", "day_low", "day_open", "day_close", "day_range")
    d = rows.join(d, keys).join(swept("london", "a"), keys, "left").join(swept("new_york", "l"), keys, "left").join(p3, keys, "left")
    d = d.withColumns({"day_high": F.col("d_high"), "day_low": F.col("d_low")})
    d = extremes_by_session(d)
    net = F.when(F.col("d_close") > F.col("d_open"), "bullish").when(F.col("d_close") < F.col("d_open"), "bearish").otherwise("neutral")

    def has(column: str, *sides: str) -> Column:
        return F.coalesce(F.col(column).isin(*sides), F.lit(False))

    yes = lambda c: F.coalesce(c, F.lit(False))
    a_high, a_low = has("a_side", "high", "both"), has("a_side", "low", "both")
    l_high, l_low = has("l_side", "high", "both"), has("l_side", "low", "both")
    asia, ldn, ny = (F.col(f"{x}_high").isNotNull() for x in ("asia", "ldn", "ny"))
    asia_dir, ldn_dir, ny_dir = (F.when(F.col(f"{x}_high").isNotNull(), _direction(x)) for x in ("asia", "ldn", "ny"))
    cont = yes(ldn & ny & (ldn_dir == ny_dir))
    asia_size = F.col("asia_high") - F.col("asia_low")
    ldn_pct, ny_pct = ((F.col(f"{x}_high") - F.col(f"{x}_low")) / F.col(f"{x}_low") * 100 for x in ("ldn", "ny"))
    derived = yes(asia & ldn & (net != "neutral") & (F.col("expansion") >= 1.3) & (asia_size > 0) & (F.col("size") >= 2 * asia_size))
    archetype = (
        F.when(yes((F.col("d_high") < F.col("prev_high")) & (F.col("d_low") > F.col("prev_low"))), "inside_day")
        .when(yes((F.col("d_high") > F.col("prev_high")) & (F.col("d_low") < F.col("prev_low"))), "outside_day")
        .when(yes((F.col("p3_dir") == "bullish") & has("p3_side", "low", "both")), "power_of_3_long")
        .when(yes((F.col("p3_dir") == "bearish") & has("p3_side", "high", "both")), "power_of_3_short")
        .when(derived & a_low & (net == "bullish"), "power_of_3_long")
        .when(derived & a_high & (net == "bearish"), "power_of_3_short")
        .when((a_high | a_low) & (l_high | l_low), "double_sweep_expansion")
        .when(yes(F.col("a_rev")) & a_high & (net == "bearish"), "asia_high_london_reversal")
        .when(yes(F.col("a_rev")) & a_low & (net == "bullish"), "asia_low_london_reversal")
        .when(yes(asia_dir == net) & cont & ~(a_high & (net == "bearish")) & ~(a_low & (net == "bullish")), "asia_breakout_continuation")
        .when(yes(ldn_dir == net) & cont & yes(ldn_pct > 0), "london_breakout_continuation")
        .when(yes(ny_dir == ldn_dir) & yes(ny_pct >= ldn_pct) & yes((F.col("hod_session") == "new_york") | (F.col("lod_session") == "new_york")), "ny_breakout_continuation")
        .otherwise("consolidation_drift")
    )
    regime = F.create_map(*[F.lit(x) for kv in REGIMES.items() for x in kv])
    out = d.select(
        "symbol", "day", archetype.alias("archetype"), "day_of_week", q("size").alias("day_range"), q(F.col("size") / F.col("d_low") * 100, 3).alias("day_range_pct"),
        "hod_session", "lod_session", a_high.alias("swept_asia_high"), a_low.alias("swept_asia_low"), l_high.alias("swept_london_high"), l_low.alias("swept_london_low"),
        cont.alias("ny_continuation"), net.alias("net_direction"), q("expansion", 3).alias("expansion_factor"),
    )
    return out.withColumn("regime", regime[F.col("archetype")])
