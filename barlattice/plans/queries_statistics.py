"""Registered queries of the endpoints' statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import sessions as S
from ..operators import statistics as Z
from .queries import bars, query


def ranges(spark, sf_dir):
    return S.session_ranges(bars(spark, sf_dir, 3600))


@query
def k07_ranges(spark, sf_dir):
    return Z.range_summary(ranges(spark, sf_dir))


@query
def k07_sweeps(spark, sf_dir):
    b = bars(spark, sf_dir, 3600)
    return Z.sweep_summary(S.session_ranges(b), S.sweeps(b))


@query
def k07_continuation(spark, sf_dir):
    return Z.continuation_summary(S.continuations(bars(spark, sf_dir, 3600)))


@query
def k07_power_of_three(spark, sf_dir):
    b = bars(spark, sf_dir, 3600)
    return Z.power_of_three_summary(S.power_of_three(b), S.day_rows(b))


@query
def k07_weekdays(spark, sf_dir):
    return Z.weekday_ranges(ranges(spark, sf_dir))


def prior(spark, sf_dir):
    return S.prior_day_touch(bars(spark, sf_dir, 3600))


@query
def k13_sides(spark, sf_dir):
    return Z.prior_day_sides(prior(spark, sf_dir))


@query
def k13_outcomes(spark, sf_dir):
    return Z.prior_day_outcomes(prior(spark, sf_dir))


@query
def k13_weekdays(spark, sf_dir):
    return Z.prior_day_weekdays(prior(spark, sf_dir))


def balance(spark, sf_dir):
    return S.initial_balance(bars(spark, sf_dir, 300), bars(spark, sf_dir, 3600))


@query
def d15_breakouts(spark, sf_dir):
    return Z.break_summary(balance(spark, sf_dir))


@query
def d15_extension(spark, sf_dir):
    return Z.balance_extension(balance(spark, sf_dir))


@query
def d15_weekdays(spark, sf_dir):
    return Z.balance_weekdays(balance(spark, sf_dir))


def opening(spark, sf_dir):
    return S.opening_range(bars(spark, sf_dir, 300))


@query
def d16_breakouts(spark, sf_dir):
    return Z.break_summary(opening(spark, sf_dir))


@query
def d16_extension(spark, sf_dir):
    return Z.opening_extension(opening(spark, sf_dir))


@query
def d16_weekdays(spark, sf_dir):
    return Z.opening_weekdays(opening(spark, sf_dir))


def day_types(spark, sf_dir):
    return S.day_types(bars(spark, sf_dir, 3600))


@query
def d18_regimes(spark, sf_dir):
    return Z.regimes(day_types(spark, sf_dir))


@query
def f05_archetypes(spark, sf_dir):
    return Z.archetypes(day_types(spark, sf_dir)).withColumn("last_seen", F.col("last_seen").cast("string"))


@query
def d18_weekdays(spark, sf_dir):
    return Z.archetype_weekdays(day_types(spark, sf_dir))


@query
def d20_session_ranges(spark, sf_dir):
    return Z.session_range_distributions(ranges(spark, sf_dir))


@query
def d19_grid(spark, sf_dir):
    return Z.extension_grid(S.breakouts(bars(spark, sf_dir, 3600)))


@query
def d21_directions(spark, sf_dir):
    return Z.day_direction(S.day_summaries(bars(spark, sf_dir, 3600)))


def seen(spark, sf_dir):
    b = bars(spark, sf_dir, 3600)
    return Z.of_session_days(S.session_ranges(b), S.day_summaries(b))


@query
def d22_extremes(spark, sf_dir):
    return Z.extremes_of_sessions(seen(spark, sf_dir))


@query
def d23_directions(spark, sf_dir):
    return Z.direction_of_sessions(seen(spark, sf_dir))


@query
def d25_windows(spark, sf_dir):
    return Z.timing_of_sessions(seen(spark, sf_dir))


@query
def d24_matrix(spark, sf_dir):
    return Z.peak_matrix(S.peak_points(bars(spark, sf_dir, 3600)))


@query
def d24_marginals(spark, sf_dir):
    return Z.peak_marginals(S.peak_points(bars(spark, sf_dir, 3600)))


def touches(spark, sf_dir):
    return P.prior_profile_touches(bars(spark, sf_dir, 900), bars(spark, sf_dir, 3600))


@query
def d17_touches(spark, sf_dir):
    return Z.touch_summary(touches(spark, sf_dir))


@query
def d17_extension(spark, sf_dir):
    return Z.profile_extension(touches(spark, sf_dir))


@query
def d17_weekdays(spark, sf_dir):
    return Z.touch_weekdays(touches(spark, sf_dir))


@query
def fc01_forecast_london(spark, sf_dir):
    return Z.forecast(bars(spark, sf_dir, 3600), "2024-01-20 05:00:00")


@query
def fc01_forecast_new_york(spark, sf_dir):
    return Z.forecast(bars(spark, sf_dir, 3600), "2024-01-20 10:30:00")


@query
def fc01_forecast_asia(spark, sf_dir):
    return Z.forecast(bars(spark, sf_dir, 3600), "2024-01-20 22:00:00")


# ---- backtests, aggregates, gates ------------------------------------------------------------------

from ..operators import backtest as X  # noqa: E402
from ..operators import indicators as I  # noqa: E402
from ..operators import outcomes as O  # noqa: E402
from ..operators import structure as T  # noqa: E402
from ..sources import market as M  # noqa: E402
from .queries import indexed, series, smc_outcomes  # noqa: E402


def doubles(df, *names):
    """Counts that some rows don't have, as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c in names})


COUNTS = ("swept_high", "swept_low", "swept_both", "reversal_count")


def all_facts(spark, sf_dir):
    return X.facts(bars(spark, sf_dir, 3600), indexed(spark, sf_dir, 3600))


@query
def bt01_outcomes(spark, sf_dir):
    """All eleven branches."""
    return doubles(X.outcomes(all_facts(spark, sf_dir)), *COUNTS)


@query
def bt01_sweep_side(spark, sf_dir):
    return doubles(X.outcomes(X.matching(X.facts(bars(spark, sf_dir, 3600)), sweep_side="high", range_state="tight"), "symbol"), *COUNTS)


@query
def bt01_htf_bias(spark, sf_dir):
    return doubles(X.outcomes(X.matching(all_facts(spark, sf_dir), htf_bias="bearish", macro_present="yes")), *COUNTS)


@query
def bt01_direction(spark, sf_dir):
    return doubles(X.outcomes(X.matching(X.facts(bars(spark, sf_dir, 3600)), direction="bullish", day_of_week="Monday")), *COUNTS)


@query
def d13_success(spark, sf_dir):
    return X.by_weekday(X.facts(bars(spark, sf_dir, 3600)))


@query
def d11_aggregates(spark, sf_dir):
    return doubles(O.statistics(smc_outcomes(spark, sf_dir)), "bullish", "bearish", "eqh", "eql", "wick", "retest")


@query
def d12_baselines(spark, sf_dir):
    return X.baselines(X.facts(bars(spark, sf_dir, 3600)))


@query
def f03_extremes(spark, sf_dir):
    return X.extremes(X.edges(X.session_events(bars(spark, sf_dir, 3600))), top=10, min_edge_pct=1.0).drop("filters")


@query
def f04_ranked_read(spark, sf_dir):
    return I.ranked_read(I.base_read(bars(spark, sf_dir, 3600), "click"))


@query
def cnf04_adr_ratio(spark, sf_dir):
    return I.adr_ratio(bars(spark, sf_dir, 3600))


@query
def b12_recent_equal_levels(spark, sf_dir):
    return T.recent_equal_levels(series(spark, sf_dir), 20).withColumn("level", F.floor(F.col("level") * 1e6 + 0.5) / 1e6)


@query
def smc13_gate(spark, sf_dir):
    """Bars of the first two days, of the symbols with enough of them for a swing pivot."""
    b = bars(spark, sf_dir, 3600).where("bar_ts < timestamp_ntz '2024-01-03 00:00:00'")
    return T.long_enough(b, 20).select("symbol", "bar_ts", "close")


@query
def b10_enough_days(spark, sf_dir):
    d = S.opening_range(bars(spark, sf_dir, 300))
    return T.enough(d, 10, what="day").groupBy("symbol").agg(F.count("*").alias("days"))


@query
def a03_complete_scan(spark, sf_dir):
    """Bars that have ended before a point in time; the one still forming is left out."""
    b = bars(spark, sf_dir, 3600)
    flagged = b.withColumn("complete", F.expr("bar_ts + interval 1 hour <= timestamp_ntz '2024-01-20 10:30:00'"))
    return M.scan(flagged.union(flagged), symbols=["click", "view"], complete="complete", limit=2000, most=M.MOST["fx"])


@query
def a07_series(spark, sf_dir):
    p = M.positioning(spark, sf_dir)
    few = p.where("dayofmonth(ts) <= 20").select("ts", "buy_vol")
    return M.series_of({"oi": p.select("ts", "oi"), "ratio": p.select("ts", "ratio")}, {"buy_vol": few, "sell_vol": None}, ["ts"]).withColumn("ratio", F.floor(F.col("ratio") * 1e6 + 0.5) / 1e6)
