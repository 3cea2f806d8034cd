from datetime import datetime, timedelta

from helpers import BARS, bars

from barlattice.operators import sessions as S


def day(spark, shape, start="2024-01-02 00:00:00"):
    """Hourly bars from hour to (open, high, low, close)."""
    t0 = datetime.fromisoformat(start)
    return spark.createDataFrame([("X", t0 + timedelta(hours=h), *map(float, v), 1.0) for h, v in shape.items()], BARS)


SWEPT = {2: (100, 110, 90, 100), 9: (100, 112, 95, 105), 14: (105, 108, 100, 101)}


def test_sweep_and_reversal(spark):
    r = {x.session: x for x in S.sweeps(day(spark, SWEPT)).collect()}
    assert r["london"].swept_side == "high" and r["london"].reversal and r["london"].sweep_price == 112
    assert r["london"].reversal_distance == 7 and "new_york" not in r


def test_both_sides_in_one_bar_end_low(spark):
    r = S.sweeps(day(spark, {2: (100, 110, 90, 100), 9: (100, 112, 88, 100)})).first()
    assert r.swept_side == "both" and r.sweep_price == 88 and r.reversal_distance == 12


def test_peak_points_take_the_earlier_on_ties(spark):
    r = S.peak_points(day(spark, {2: (100, 110, 90, 100), 10: (100, 110, 95, 100), 16: (100, 105, 90, 100)})).first()
    assert (r.hod_session, r.lod_session) == ("asia", "asia")


def test_breakout_order(spark):
    r = S.breakouts(day(spark, {2: (100, 110, 90, 100), 9: (100, 111, 95, 100), 10: (100, 105, 89, 100)})).where("session = 'london'").first()
    assert (r.cell, r.sequence, r.overshoot) == ("both", "h_then_l", 1.0)


def orb(spark, after):
    rows = [(95, 100, 90, 95)] * 3 + after
    return S.opening_range(bars(spark, rows, start="2024-01-02 13:30:00", minutes=5)).first()


def test_opening_range(spark):
    assert orb(spark, [(95, 101, 94, 100)]).outcome == "only_h"
    assert orb(spark, [(95, 96, 89, 90)]).first_break_side == "low"
    touch = orb(spark, [(95, 100, 90, 95)])
    assert touch.outcome == "both" and touch.first_break_side == "high"
    assert orb(spark, [(95, 96, 94, 95)]).outcome == "neither"


def test_initial_balance_falls_back_to_hours(spark):
    hourly = bars(spark, [(95, 100, 90, 95)] * 4, start="2024-01-02 13:30:00", minutes=60)
    r = S.initial_balance(hourly.limit(0), hourly).first()
    assert r.source == "1H" and r.outcome == "neither" and r.size_to_extension is None


def test_prior_day(spark):
    two = day(spark, {3: (100, 110, 90, 100)}, "2024-01-01 00:00:00").union(day(spark, {3: (100, 110, 95, 105)}))
    r = S.prior_day_touch(two).first()
    assert r.outcome == "pdh_only" and r.pdh_reversal and not r.pdh_held


def test_no_bars_no_rows(spark):
    none = day(spark, SWEPT).limit(0)
    for f in (S.session_ranges, S.sweeps, S.continuations, S.power_of_three, S.prior_day_touch, S.day_types, S.peak_points):
        assert f(none).count() == 0
