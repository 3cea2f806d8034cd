"""Statistics of sessions and days, as the endpoints return them.

Each takes rows of the session operators and gives one frame per block of an
endpoint, with a row for each symbol and group. All are grouped aggregates with
partial aggregation before their shuffle; counts of whole windows come along as
``n``, so that a rate is never without its sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SESSIONS, clock, confidence, confidence_b, n_if, over, q, rate
from ..functions.lineage import written_once
from . import quantiles
from . import sessions as S

QUARTILES = [0.25, 0.5, 0.75]
OUTCOMES = ("only_h", "only_l", "both", "neither")


def millionths(x) -> Column:
    """A figure as a whole number of millionths, so that sums are exact in any order."""
    return F.floor((F.col(x) if isinstance(x, str) else x) * 1e6 + 0.5)


def mean(x, places: int) -> Column:
    """Rounded mean, 0 for none."""
    return F.coalesce(F.floor(F.avg(millionths(x)) / 10.0 ** (6 - places) + 0.5) / 10.0**places, F.lit(0.0))


def average_time(hhmm: str) -> Column:
    """Mean of HH:MM strings, null for none."""
    return clock(F.avg(F.substring(hhmm, 1, 2).cast("int") * 60 + F.substring(hhmm, 4, 2).cast("int")))


def distributions(rows: DataFrame, metrics: dict[str, tuple[Column, int]], *by: str) -> DataFrame:
    """``by, metric, n, mean, min, max, p25, median, p75, confidence``: a row for
    each metric (its values and decimals) that has any value."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), x.cast("double").alias("x"), F.lit(10.0**places).alias("scale")) for name, (x, places) in metrics.items()]))
    values = written_once(rows.select(*by, each.alias("m")).select(*by, "m.*").where("x is not null"), "metrics")
    keys = [*by, "metric", "scale"]
    plain = values.groupBy(*keys).agg(F.count("*").alias("n"), (F.avg(millionths("x")) / 1e6).alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    quartiles = quantiles.exact(values, keys, "x", QUARTILES).drop("n")
    q1 = [F.get("quantiles", F.lit(at)).alias(name) for at, name in enumerate(("p25", "median", "p75"))]
    same = [plain[k].eqNullSafe(quartiles[k]) for k in keys]
    raw = plain.join(quartiles, same).select(*[plain[c] for c in plain.columns], *q1)
    figures = [(F.floor(F.col(c) * F.col("scale") + 0.5) / F.col("scale")).alias(c) for c in ("mean", "min", "max", "p25", "median", "p75")]
    return raw.select(*by, "metric", "n", *figures, confidence_b("n").alias("confidence"))


# ---- sessions ------------------------------------------------------------------------------------


def range_summary(ranges: DataFrame) -> DataFrame:
    """Mean ranges of each session, of all days and by direction."""
    n, bull = F.count("*"), F.col("direction") == "bullish"
    return ranges.groupBy("symbol", "session").agg(
        n.alias("total_sessions"), mean("range", 6).alias("avg_range"), mean("range_pct", 3).alias("avg_range_pct"), rate(n_if(bull), n).alias("bullish_pct"), rate(n_if(~bull), n).alias("bearish_pct"),
        mean(F.when(bull, F.col("range")), 6).alias("avg_bull_range"), mean(F.when(~bull, F.col("range")), 6).alias("avg_bear_range"),
    )


def weekday_ranges(ranges: DataFrame) -> DataFrame:
    n = F.count("*")
    return ranges.groupBy("symbol", "session", "day_of_week").agg(n.alias("count"), mean("range", 6).alias("avg_range"), mean("range_pct", 3).alias("avg_range_pct"), rate(n_if(F.col("direction") == "bullish"), n).alias("bullish_pct"))


def prior_days(ranges: DataFrame) -> DataFrame:
    """For each session that has one before it, the days with that one."""
    following = F.when(F.col("session") == "asia", "london").when(F.col("session") == "london", "new_york")
    return ranges.select("symbol", following.alias("session")).where("session is not null").groupBy("symbol", "session").agg(F.count("*").alias("total_days"))


def sweep_summary(ranges: DataFrame, sweeps: DataFrame) -> DataFrame:
    """How often a session sweeps the one before, of the days with that one."""
    side = F.col("swept_side")
    s = sweeps.groupBy("symbol", "session").agg(
        F.count("*").alias("sweep_count"), n_if(side == "high").alias("swept_high"), n_if(side == "low").alias("swept_low"), n_if(side == "both").alias("swept_both"), n_if(F.col("reversal")).alias("reversals")
    )
    j = prior_days(ranges).join(s, ["symbol", "session"], "left").na.fill(0)
    return j.select("symbol", "session", "total_days", "sweep_count", rate("sweep_count", "total_days").alias("sweep_rate"), "swept_high", "swept_low", "swept_both", rate("reversals", "sweep_count").alias("reversal_rate"))


def continuation_summary(continuations: DataFrame) -> DataFrame:
    n, went_on = F.count("*"), n_if(F.col("continuation"))
    return continuations.groupBy("symbol").agg(n.alias("total_days"), went_on.alias("continuation_count"), rate(went_on, n).alias("continuation_rate"), rate(n - went_on, n).alias("reversal_rate"))


def power_of_three_summary(patterns: DataFrame, days: DataFrame) -> DataFrame:
    """Success of the pattern, and how often it forms on days with Asia and London."""
    n, side = F.count("*"), F.col("manipulation_side")
    p = patterns.groupBy("symbol").agg(
        n.alias("total_patterns"), n_if(F.col("success")).alias("success_count"), rate(n_if(F.col("success")), n).alias("success_rate"),
        n_if(side == "high").alias("swept_high"), n_if(side == "low").alias("swept_low"), mean("asia_pct_of_adr", 1).alias("avg_asia_range_pct"),
    )
    eligible = days.groupBy("symbol").agg(n_if(F.col("asia_high").isNotNull() & F.col("ldn_high").isNotNull()).alias("eligible_days"))
    return p.join(eligible, "symbol").withColumn("occurrence_rate", rate("total_patterns", "eligible_days"))


# ---- the day before --------------------------------------------------------------------------------


def prior_day_sides(days: DataFrame) -> DataFrame:
    """Per symbol and side (pdh, pdl): how often it is reached, and what follows."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"touched_{s}").alias("touched"), F.col(f"{s}_reversal").alias("reversal"), F.col(f"{s}_held").alias("held"), F.when(F.col(f"touched_{s}"), F.col(f"{s}_touch_time")).alias("at")) for s in ("pdh", "pdl")])
    n, hit = F.count("*"), n_if(F.col("touched"))
    return days.select("symbol", F.explode(sides).alias("x")).select("symbol", "x.*").groupBy("symbol", "side").agg(
        n.alias("n"), rate(hit, n).alias("sweep_rate"), hit.alias("sweep_count"), rate(n_if(F.col("reversal")), hit).alias("reversal_rate_when_swept"), rate(n_if(F.col("held")), hit).alias("hold_rate_when_swept"), average_time("at").alias("avg_touch_time")
    )


def prior_day_outcomes(days: DataFrame) -> DataFrame:
    n = F.count("*")
    return days.groupBy("symbol").agg(n.alias("n"), *[rate(n_if(F.col("outcome") == o), n).alias(f"{o}_pct") for o in ("pdh_only", "pdl_only", "both", "neither")])


def prior_day_weekdays(days: DataFrame) -> DataFrame:
    n = F.count("*")
    return days.groupBy("symbol", "day_of_week").agg(
        n.alias("count"), rate(n_if(F.col("touched_pdh")), n).alias("pdh_pct"), rate(n_if(F.col("touched_pdl")), n).alias("pdl_pct"), rate(n_if(F.col("outcome") == "both"), n).alias("both_pct"), rate(n_if(F.col("outcome") == "neither"), n).alias("neither_pct")
    )


# ---- opening ranges --------------------------------------------------------------------------------


def break_summary(days: DataFrame) -> DataFrame:
    """How opening ranges break: outcomes, the first side, the mean time."""
    n, side = F.count("*"), F.col("first_break_side")
    held = n_if(F.col("outcome") == "neither")
    return days.groupBy("symbol").agg(
        n.alias("n"), confidence_b(n).alias("confidence"), *[rate(n_if(F.col("outcome") == o), n).alias(f"{o}_pct") for o in OUTCOMES], rate(n - held, n).alias("breakout_rate"), rate(held, n).alias("hold_rate"),
        rate(n_if(side == "high"), n).alias("first_break_high_pct"), rate(n_if(side == "low"), n).alias("first_break_low_pct"), rate(n_if(side.isNull()), n).alias("first_break_none_pct"), average_time("first_break_time").alias("avg_first_break_time"),
    )


def balance_extension(days: DataFrame) -> DataFrame:
    metrics = {"ib_size": ("ib_size", 6), "ib_size_pct": ("ib_size_pct", 3), "ib_up_extension": ("up_extension", 6), "ib_down_extension": ("down_extension", 6), "max_extension": ("max_extension", 6), "size_to_extension_ratio": ("size_to_extension", 3)}
    return distributions(days, {k: (F.col(c), p) for k, (c, p) in metrics.items()}, "symbol")


def balance_weekdays(days: DataFrame) -> DataFrame:
    n = F.count("*")
    return days.groupBy("symbol", "day_of_week").agg(n.alias("count"), mean("ib_size_pct", 3).alias("avg_ib_size_pct"), rate(n_if(F.col("outcome") == "neither"), n).alias("neither_pct"), rate(n_if(F.col("outcome") == "both"), n).alias("both_pct"))


def opening_extension(days: DataFrame) -> DataFrame:
    size = F.col("orb_size")
    multiple = lambda c: F.when(size > 0, F.col(c) / size)
    metrics = {
        "orb_size": (size, 6), "orb_up_extension": (F.col("up_extension"), 6), "orb_down_extension": (F.col("down_extension"), 6),
        "orb_up_extension_x_size": (multiple("up_extension"), 3), "orb_down_extension_x_size": (multiple("down_extension"), 3),
    }
    return distributions(days, metrics, "symbol")


def opening_weekdays(days: DataFrame) -> DataFrame:
    n = F.count("*")
    return days.groupBy("symbol", "day_of_week").agg(n.alias("count"), mean("orb_size", 6).alias("avg_orb_size"), rate(n_if(F.col("outcome") == "neither"), n).alias("neither_pct"), rate(n_if(F.col("outcome") == "both"), n).alias("both_pct"))


# ---- types of days -----------------------------------------------------------------------------------


def _all_of(days: DataFrame, names: list[str], column: str) -> DataFrame:
    """Each symbol with each of ``names``, also those that never occur."""
    return days.select("symbol").distinct().withColumn(column, F.explode(F.array(*[F.lit(x) for x in names])))


def _with_total(counts: DataFrame, days: DataFrame) -> DataFrame:
    return counts.join(days.groupBy("symbol").agg(F.count("*").alias("days")), "symbol")


def regimes(days: DataFrame) -> DataFrame:
    found = days.groupBy("symbol", "regime").agg(F.count("*").alias("count"))
    out = _all_of(days, list(dict.fromkeys(S.REGIMES.values())), "regime").join(found, ["symbol", "regime"], "left").na.fill(0, ["count"])
    return _with_total(out, days).select("symbol", "regime", "count", rate("count", "days").alias("pct"))


def archetypes(days: DataFrame) -> DataFrame:
    """Every archetype with its share, mean range and last day, ``rank`` by share."""
    found = days.groupBy("symbol", "archetype").agg(F.count("*").alias("count"), mean("day_range", 6).alias("avg_range"), mean("day_range_pct", 3).alias("avg_range_pct"), F.max("day").alias("last_seen"))
    out = _all_of(days, list(S.REGIMES), "archetype").join(found, ["symbol", "archetype"], "left").na.fill(0, ["count", "avg_range", "avg_range_pct"])
    order = F.create_map(*[x for i, k in enumerate(S.REGIMES) for x in (F.lit(k), F.lit(i))])[F.col("archetype")]
    regime = F.create_map(*[F.lit(x) for kv in S.REGIMES.items() for x in kv])[F.col("archetype")]
    out = _with_total(out, days).withColumn("pct", rate("count", "days"))
    return out.select("symbol", "archetype", regime.alias("regime"), "count", "pct", "avg_range", "avg_range_pct", "last_seen", F.row_number().over(over(F.col("pct").desc(), order)).alias("rank"))


def archetype_weekdays(days: DataFrame) -> DataFrame:
    """Per weekday its commonest archetype and regime; of equals the one seen first."""

    def top(column: str) -> DataFrame:
        each = days.groupBy("symbol", "day_of_week", column).agg(F.count("*").alias("k"), F.min("day").alias("first"))
        return each.groupBy("symbol", "day_of_week").agg(F.min_by(column, F.struct(-F.col("k"), "first")).alias(f"top_{column}"), F.sum("k").alias("count"))

    return top("archetype").join(top("regime").drop("count"), ["symbol", "day_of_week"])


# ---- extension of sessions, the session card -----------------------------------------------------------


def session_range_distributions(ranges: DataFrame) -> DataFrame:
    return distributions(ranges, {"range": (F.col("range"), 6), "range_pct": (F.col("range_pct"), 3)}, "symbol", "session")


def extension_grid(breakouts: DataFrame) -> DataFrame:
    """How London and New York extend beyond the session before them."""
    n, cell = F.count("*"), F.col("cell")
    return breakouts.groupBy("symbol", "session").agg(
        n.alias("n"), rate(n_if(cell != "neither"), n).alias("extension_rate"), *[rate(n_if(cell == o), n).alias(f"{o}_pct") for o in OUTCOMES],
        rate(n_if(F.col("sequence") == "h_then_l"), n).alias("h_then_l_pct"), rate(n_if(F.col("sequence") == "l_then_h"), n).alias("l_then_h_pct"),
        mean("overshoot", 6).alias("avg_overshoot"), mean("overshoot_multiple", 3).alias("avg_overshoot_multiple"), F.count("overshoot").alias("overshoot_sample"),
    )


def day_direction(summaries: DataFrame) -> DataFrame:
    n = F.count("*")
    return summaries.groupBy("symbol").agg(n.alias("n"), rate(n_if(F.col("direction") == "long"), n).alias("long_day_pct"), rate(n_if(F.col("direction") == "short"), n).alias("short_day_pct"), mean("up_leg", 6).alias("avg_up_leg"), mean("down_leg", 6).alias("avg_down_leg"))


def of_session_days(ranges: DataFrame, summaries: DataFrame) -> DataFrame:
    """The day summaries once for each session that the day has."""
    return ranges.select("symbol", "day", "session", "high_time", "low_time").join(summaries, ["symbol", "day"])


def extremes_of_sessions(seen: DataFrame) -> DataFrame:
    """How often a session prints the day's high or low, of the days that have it."""
    n, hod, lod = F.count("*"), F.col("hod_session") == F.col("session"), F.col("lod_session") == F.col("session")
    return seen.groupBy("symbol", "session").agg(n.alias("n"), rate(n_if(hod), n).alias("hod_pct"), rate(n_if(lod), n).alias("lod_pct"), rate(n_if(hod & lod), n).alias("both_pct"), rate(n_if(~hod & ~lod), n).alias("neither_pct"), confidence(n).alias("confidence"))


def direction_of_sessions(seen: DataFrame) -> DataFrame:
    """Long and short days of a session's days, in all (null weekday) and by weekday."""
    n, long = F.count("*"), n_if(F.col("direction") == "long")
    return seen.groupingSets([["symbol", "session"], ["symbol", "session", "day_of_week"]], "symbol", "session", "day_of_week").agg(n.alias("count"), rate(long, n).alias("long_pct"), rate(n - long, n).alias("short_pct"))


def timing_of_sessions(seen: DataFrame) -> DataFrame:
    """When a session's high and low form, on long and on short days: the window
    from the first to the third quartile of hours, and the median hour."""
    p = lambda c: F.percentile(F.substring(c, 1, 2).cast("int"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    hour = lambda x: F.floor(x + 0.5)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    out = seen.groupBy("symbol", "session", "direction").agg(F.count("*").alias("sample_size"), p("high_time").alias("h"), p("low_time").alias("l"))
    window = lambda c: F.concat(two(hour(F.col(c)[0])), F.lit(":00-"), two(hour(F.col(c)[2])), F.lit(":59"))
    return out.select("symbol", "session", "direction", "sample_size", window("h").alias("high_window"), window("l").alias("low_window"), hour(F.col("h")[1]).alias("high_peak_hour"), hour(F.col("l")[1]).alias("low_peak_hour"))


# ---- peaks -----------------------------------------------------------------------------------------


def _of_days(points: DataFrame) -> DataFrame:
    """Each day under ``all`` and under its direction."""
    return points.withColumn("days", F.explode(F.array(F.lit("all"), F.concat("net_direction", F.lit("_day")))))


def peak_matrix(points: DataFrame) -> DataFrame:
    """Joint shares of the sessions of the day's high and low, every pair a row."""
    rows = _of_days(points)
    total = rows.groupBy("symbol", "days").agg(F.count("*").alias("sample_size"))
    names = F.array(*[F.lit(s) for s in SESSIONS])
    grid = total.withColumn("hod_session", F.explode(names)).withColumn("lod_session", F.explode(names))
    found = rows.groupBy("symbol", "days", "hod_session", "lod_session").agg(F.count("*").alias("n"))
    out = grid.join(found, ["symbol", "days", "hod_session", "lod_session"], "left").na.fill(0, ["n"])
    return out.select("symbol", "days", "hod_session", "lod_session", "n", rate("n", "sample_size").alias("pct"), "sample_size", confidence("sample_size").alias("confidence"))


def peak_marginals(points: DataFrame) -> DataFrame:
    m = peak_matrix(points)
    keys = ["symbol", "days", "sample_size"]
    side = lambda c: m.groupBy(*keys, F.col(f"{c}_session").alias("session")).agg(F.sum("n").alias(c))
    j = side("hod").join(side("lod"), [*keys, "session"])
    return j.select("symbol", "days", "session", "hod", rate("hod", "sample_size").alias("hod_pct"), "lod", rate("lod", "sample_size").alias("lod_pct"), "sample_size")


# ---- profiles of the day before ------------------------------------------------------------------------


def touch_summary(days: DataFrame) -> DataFrame:
    n, levels = F.count("*"), ("poc", "vah", "val")
    return days.groupBy("symbol").agg(
        n.alias("n"), confidence_b(n).alias("confidence"), *[rate(n_if(F.col(f"touched_{x}")), n).alias(f"prev_{x}_pct") for x in levels], rate(n_if(F.col("total_tpos") >= 10), n).alias("tpo_quality_normal_pct"),
        *[average_time(f"{x}_time").alias(f"avg_prev_{x}_touch_time") for x in levels],
    )


def touch_weekdays(days: DataFrame) -> DataFrame:
    n = F.count("*")
    return days.groupBy("symbol", "day_of_week").agg(n.alias("count"), *[rate(n_if(F.col(f"touched_{x}")), n).alias(f"prev_{x}_pct") for x in ("poc", "vah", "val")])


def profile_extension(days: DataFrame) -> DataFrame:
    return distributions(days, {"rth_extension": (F.col("rth_range"), 6)}, "symbol")


# ---- forecast --------------------------------------------------------------------------------------


def forecast(bars: DataFrame, as_of=None) -> DataFrame:
    """What history says about the session that the clock names next.

    ``as_of`` is a point in time (a symbol's newest bar if none is given); only
    bars up to it count. After New York, and after its close, the next session is
    Asia's, which has none before it to sweep.
    """
    if as_of is None:
        now = bars.groupBy("symbol").agg(F.max("bar_ts").alias("as_of"))
        bars = bars.join(now, "symbol")
    else:
        point = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
        bars = bars.withColumn("as_of", point).where("bar_ts <= as_of")
    hour = F.hour("as_of")
    current = F.when(hour < 8, "asia").when(hour < 13, "london").when(hour < 21, "new_york").otherwise("post_ny")
    target = F.when(hour < 8, "london").when(hour < 13, "new_york").otherwise("asia")
    before = F.when(hour < 8, "asia").when(hour < 13, "london")
    base = bars.groupBy("symbol", "as_of").agg(F.max_by("close", "bar_ts").alias("anchor_price"))
    base = base.select("symbol", "as_of", current.alias("current_session"), target.alias("forecast_session"), before.alias("prior_session"), "anchor_price")
    plain = bars.drop("as_of")
    named = base.select("symbol", "forecast_session", "prior_session")
    ranges = S.session_ranges(plain).join(named, "symbol")
    own = F.col("session") == F.col("forecast_session")
    some = own & (F.col("range_pct") > 0)
    size = F.when(some, F.col("range_pct"))
    p = [F.get("quantiles", F.lit(at)) for at in range(3)]
    quartiles = quantiles.exact(ranges.select("symbol", size.alias("size")), ["symbol"], "size", QUARTILES).select("symbol", q(p[0], 3).alias("range_low"), q(p[1], 3).alias("range_median"), q(p[2], 3).alias("range_high"))
    bull = own & (F.col("direction") == "bullish")
    prior = F.col("session") == F.col("prior_session")
    seen = ranges.groupBy("symbol").agg(
        n_if(some).alias("range_n"), q(F.min(size), 3).alias("range_min"), q(F.max(size), 3).alias("range_max"),
        n_if(own).alias("direction_n"), rate(n_if(bull), n_if(own)).alias("bullish"), rate(n_if(own & ~bull), n_if(own)).alias("bearish"), n_if(prior).alias("sweep_n"),
        F.max_by(F.when(prior, F.col("high")), F.when(prior, F.col("day"))).alias("prior_session_high"), F.max_by(F.when(prior, F.col("low")), F.when(prior, F.col("day"))).alias("prior_session_low"),
    )
    side = F.col("swept_side")
    swept = S.sweeps(plain).join(named.where("prior_session is not null"), "symbol").where("session = forecast_session").groupBy("symbol").agg(
        F.count("*").alias("sweep_count"), n_if(side == "high").alias("swept_high"), n_if(side == "low").alias("swept_low"), n_if(side == "both").alias("swept_both"), n_if(F.col("reversal")).alias("reversals")
    )
    went = S.continuations(plain).join(named.where("forecast_session = 'new_york'"), "symbol").groupBy("symbol").agg(F.count("*").alias("continuation_n"), n_if(F.col("continuation")).alias("went_on"))
    zero = ["sweep_count", "swept_high", "swept_low", "swept_both", "reversals", "continuation_n", "went_on", "range_low", "range_median", "range_high", "range_min", "range_max"]
    j = base.join(seen, "symbol").join(quartiles, "symbol", "left").join(swept, "symbol", "left").join(went, "symbol", "left").na.fill(0, zero)
    high, low = F.col("swept_high") + F.col("swept_both"), F.col("swept_low") + F.col("swept_both")
    half = F.col("anchor_price") * (F.col("range_median") / 100.0) / 2.0
    return j.select(
        "symbol", "as_of", "current_session", "forecast_session", "prior_session", "range_n", "range_median", "range_low", "range_high", "range_min", "range_max", "direction_n", "bullish", "bearish",
        "sweep_n", "sweep_count", rate("sweep_count", "sweep_n").alias("sweep_prob"), "swept_high", "swept_low", "swept_both", F.when(F.col("sweep_n") > 0, F.when(high > low, "high").when(low > high, "low").otherwise("either")).alias("likely_side"),
        rate("reversals", "sweep_count").alias("reversal_rate"), "continuation_n", rate("went_on", "continuation_n").alias("continuation"), rate(F.col("continuation_n") - F.col("went_on"), "continuation_n").alias("continuation_reversal"),
        q("anchor_price").alias("anchor_price"), q(F.col("anchor_price") + half).alias("projected_high"), q(F.col("anchor_price") - half).alias("projected_low"), q(2 * half).alias("median_range_abs"), "prior_session_high", "prior_session_low",
    )
