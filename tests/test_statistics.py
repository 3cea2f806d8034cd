"""Statistics of the endpoints on rows whose figures are known."""

from __future__ import annotations

import os

import pytest

from barlattice.api import Market
from barlattice.operators import backtest as X
from barlattice.operators import indicators as I
from barlattice.operators import sessions as S
from barlattice.operators import statistics as Z
from barlattice.operators import structure as T
from barlattice.sources import market as M
from helpers import bars, flat

SF = "/root/testdata/sf0.01"


def test_opening_range_mix(spark):
    mix = [("only_h", "high", "13:45")] * 5 + [("only_l", "low", "14:15")] * 3 + [("both", "high", "13:50"), ("neither", None, None)]
    rows = spark.createDataFrame([("X", o, s, t, 10.0, 5.0, 0.0) for o, s, t in mix], "symbol string, outcome string, first_break_side string, first_break_time string, orb_size double, up_extension double, down_extension double")
    r = Z.break_summary(rows).first()
    assert (r.only_h_pct, r.only_l_pct, r.both_pct, r.neither_pct, r.breakout_rate, r.hold_rate) == (50.0, 30.0, 10.0, 10.0, 90.0, 10.0)
    assert (r.first_break_high_pct, r.first_break_low_pct, r.first_break_none_pct, r.avg_first_break_time, r.confidence) == (60.0, 30.0, 10.0, "13:56", "low")
    got = {x.metric: x for x in Z.opening_extension(rows).collect()}
    assert got["orb_up_extension_x_size"].median == 0.5 and got["orb_size"].n == 10


def test_touch_mix(spark):
    rows = spark.createDataFrame([("X", i < 7, i < 4, i < 2, "15:00" if i < 7 else None, None, None, 50, "Monday") for i in range(10)], "symbol string, touched_poc boolean, touched_vah boolean, touched_val boolean, poc_time string, vah_time string, val_time string, total_tpos long, day_of_week string")
    r = Z.touch_summary(rows).first()
    assert (r.prev_poc_pct, r.prev_vah_pct, r.prev_val_pct, r.avg_prev_poc_touch_time, r.avg_prev_vah_touch_time) == (70.0, 40.0, 20.0, "15:00", None)


def test_forecast_follows_the_clock(spark):
    day = flat([100] * 8) + [(100, 102, 99, 101)] + flat([101] * 4) + [(101, 103, 100, 102)] + flat([102] * 10)
    b = bars(spark, day * 4)
    at = lambda t: Z.forecast(b, t).first()
    assert [at(f"2024-01-04 {t}").forecast_session for t in ("03:00:00", "09:00:00", "15:00:00", "22:00:00")] == ["london", "new_york", "asia", "asia"]
    r = at("2024-01-04 03:00:00")
    assert (r.prior_session, r.sweep_n, r.sweep_count, r.sweep_prob, r.swept_both, r.likely_side) == ("asia", 4, 3, 75.0, 3, "either")
    assert r.range_median == pytest.approx(3.03) and r.projected_high == pytest.approx(100 * (1 + 0.0303 / 2))
    assert at("2024-01-04 22:00:00").sweep_n == 0 and Z.forecast(b).first().current_session == "post_ny"


def test_conditions_and_notes(spark):
    e = spark.createDataFrame([("asia_sweep", "london", None, "high", True, 1.0, None, None), ("smc_ob_test", "asia", "bullish", None, True, None, "bullish", True), ("smc_ob_test", "asia", "bearish", None, False, None, "bearish", True), ("session_range", "asia", "bullish", None, True, 2.0, None, None)],
        "event_type string, session string, direction string, side string, win boolean, value double, htf_bias string, tested boolean")
    assert X.matching(e, sweep_side="high").count() == 1 and X.matching(e, htf_bias="bearish").count() == 1 and X.matching(e, range_state="tight").count() == 4
    assert len(X.notes(range_state="tight", macro_present="yes", event_type="smc_ob_test", day_of_week="Monday")) == 3 and X.notes(session="asia") == []
    with pytest.raises(ValueError):
        X.matching(e, colour="red")
    got = {r.event_type: r for r in X.outcomes(e).collect()}
    assert (got["smc_ob_test"].retest_rate, got["smc_ob_test"].hold_rate_when_retested, got["smc_ob_test"].fill_rate) == (100.0, 50.0, None)
    assert (got["asia_sweep"].reversal_rate, got["asia_sweep"].swept_high, got["session_range"].avg_range_pct, got["session_range"].bearish_rate) == (100.0, 1, 2.0, 0.0)


def test_gates_and_lists(spark):
    b = bars(spark, flat(range(1, 41)))
    assert T.long_enough(b, 20).count() == 0 and T.long_enough(b, 19).count() == 40
    assert I.adr_ratio(b).count() == 0 and I.adr_ratio(bars(spark, flat([1, 3] * 36))).first().ratio == 1.0
    assert M.watchlist("FX") == M.WATCHLISTS["forex"] and M.watchlist("btcusdt, ethusdt BTCUSDT") == ["BTCUSDT", "ETHUSDT"] and len(M.watchlist("")) == 8
    M.crypto_only("BTCUSDT")
    with pytest.raises(ValueError):
        M.crypto_only("EUR_USD")


def test_spans_of_bars(spark):
    b = T.of(bars(spark, flat(range(700))).selectExpr("*", "cast(bar_ts as date) as d").withColumn("bar_idx", S.F.expr("cast((unix_timestamp(cast(bar_ts as timestamp)) - 1704067200) / 3600 as int)"))).bars.select("symbol", "i")
    rows = spark.createDataFrame([("X", 0, 0), ("X", 250, 600), ("X", 10, 5), ("X", 690, 900)], "symbol string, a int, b int")
    got = T.bars_between(rows, b, ("symbol",), S.F.col("a"), S.F.col("b")).groupBy("a").count().collect()
    assert {r.a: r["count"] for r in got} == {0: 1, 250: 351, 690: 10}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_every_statistics_endpoint(spark):
    m = Market(M.ticks(spark, SF)).only("click", "view")
    r = S.session_ranges(m.bars("1h")).where("symbol = 'click' and session = 'london'").collect()
    got = m.compute_session_stats()["sessions"].where("symbol = 'click' and session = 'london'").first()
    assert got.total_sessions == len(r) and got.avg_range == pytest.approx(sum(x.range for x in r) / len(r), abs=1e-5)
    blocks = [m.compute_pdh_pdl_stats(), m.compute_ib_stats(), m.compute_day_type_stats(), m.compute_session_extension_stats(), m.compute_peak_points_stats(), m.get_session_card("London"), m.compute_orb_stats(), m.compute_eth_profile_stats()]
    for block in blocks:
        for name, df in block.items():
            assert df.limit(1).count() == 1, name
    assert m.get_session_card("asia")["breakouts"] is None and m.get_session_forecast(as_of="2024-01-20 10:30:00").count() == 2
    assert m.compute_peak_points_stats()["matrix"].where("symbol = 'view' and days = 'all'").agg({"n": "sum"}).first()[0] == S.peak_points(m.bars("1h")).where("symbol = 'view'").count()
    back = m.run_backtest("asia_sweep", sweep_side="low", range_state="tight")
    assert len(back["notes"]) == 1 and back["outcomes"].where("swept_high > 0").count() == 0
    assert m.compute_smc_stats()["overall"].columns[:2] == ["kind", "symbol"] and m.discover_edges(min_samples=2)["baselines"].count() > 0
    assert m.get_correlations(["click"], "view")["base"].columns[-1] == "rank" and set(m.analyze_smc("1h", 100)) >= {"equal_levels", "range"}
