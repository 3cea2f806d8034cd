import datetime as dt

import pytest
from helpers import bars, indexed

from barlattice.operators import backtest as X
from barlattice.operators import flow as W
from barlattice.operators import journal as J
from barlattice.operators import profile as P
from barlattice.operators.asof import asof_join


def trade(spark, after, side="bullish"):
    """London closes at 100 after bars whose range is 10; then ``after``."""
    rows = [(100, 105, 95, 100)] * 21 + after
    b = bars(spark, rows, start="2024-01-02 00:00:00")
    e = spark.createDataFrame([("X", dt.date(2024, 1, 2), "session_range", "new_york", side, None, True)], "symbol string, day date, event_type string, session string, direction string, side string, win boolean")
    return X.trades(b, e).first()


@pytest.mark.parametrize(
    ("after", "side", "reason", "r"),
    [
        ([(100, 121, 99, 120)], "bullish", "target", 2.0), ([(100, 101, 89, 90)], "bullish", "stop", -1.0), ([(100, 121, 89, 100)], "bullish", "stop_ambiguous", -1.0),
        ([(100, 106, 99, 105)], "bullish", "time", 0.5), ([(100, 101, 79, 80)], "bearish", "target", 2.0), ([(100, 111, 99, 110)], "bearish", "stop", -1.0),
    ],
)
def test_first_touch(spark, after, side, reason, r):
    got = trade(spark, after, side)
    assert (got.exit_reason, got.r) == (reason, r)


def test_skips(spark):
    assert trade(spark, []).skip == "no_forward_bars"
    assert trade(spark, [(100, 101, 99, 100)], None).skip == "no_direction"


def test_equity(spark):
    rows = [("X", i, dt.date(2024, 1, 2), "e", "s", r, None) for i, r in enumerate([2.0, -1.0, -1.0, 2.0])]
    t = spark.createDataFrame(rows, "symbol string, bar_idx long, day date, event_type string, session string, r double, skip string")
    e = X.equity(t, ["symbol"]).first()
    assert (e.trades, e.win_rate, e.expectancy, e.profit_factor, e.total_r, e.max_drawdown) == (4, 50.0, 0.5, 2.0, 2.0, 2.0)
    assert X.equity(t.limit(0), ["symbol"]).count() == 0


def test_edges_drop_unknown_dimensions(spark):
    rows = [("a", "asia", None, None, None, i % 2 == 0) for i in range(20)]
    e = spark.createDataFrame(rows, "event_type string, session string, day_of_week string, direction string, side string, win boolean")
    got = X.edges(e).collect()
    assert [(r.session, r.n, r.win_rate, r.edge_score, r["filters"]) for r in got] == [("asia", 20, 50.0, 0.0, {"session": "asia"})]


def request(spark, **kw):
    row = dict(request_id=1, equity=10000.0, risk_pct=1.0, entry=100.0, stop=95.0, target=115.0, side=None, leverage=1.0) | kw
    return W.position_size(spark.createDataFrame([row], "request_id long, equity double, risk_pct double, entry double, stop double, target double, side string, leverage double")).first()


def test_position_size(spark):
    r = request(spark)
    assert (r.side, r.units, r.rr, r.breakeven_pct) == ("long", 20.0, 3.0, 25.0)
    assert request(spark, stop=105.0, target=None).side == "short"
    assert request(spark, stop=100.0).error == "stop equals entry"
    assert request(spark, stop=105.0, side="long").error == "stop is on the wrong side"
    assert request(spark, equity=0.0).units is None and request(spark, risk_pct=101.0).error


@pytest.mark.parametrize(("at", "session", "zone"), [("02:00", "asia", None), ("07:30", "asia", "London Silver Bullet"), ("09:30", "london", None), ("13:30", "new_york", "NY Open"), ("22:00", "post_ny", None)])
def test_clock(spark, at, session, zone):
    h, m = map(int, at.split(":"))
    r = W.session_clock(spark.createDataFrame([(dt.datetime(2024, 1, 2, h, m),)], "ts timestamp_ntz")).first()
    assert (r.session, r.killzone) == (session, zone)


def test_profile_invariant(spark):
    b = indexed(spark, [(100 + i, 101 + i, 99 + i, 100 + i) for i in range(96)], minutes=15)
    for p in P.profiles(P.recent_sessions(b, "15m", 10), ["symbol", "sess"]).collect():
        assert p.val <= p.poc <= p.vah and p.total_tpos > 0


def test_asof_join(spark):
    l = spark.createDataFrame([("a", 1, 10), ("a", 5, 11), ("b", 5, 12)], "k string, t int, v int")
    r = spark.createDataFrame([("a", 1, 100), ("a", 4, 101)], "k string, t int, w int")
    assert {(x.v, x.w) for x in asof_join(l, r, by=["k"], on="t").collect()} == {(10, 100), (11, 101), (12, None)}
    assert {(x.v, x.w) for x in asof_join(l, r, by=["k"], on="t", strict=True).collect()} == {(10, None), (11, 101), (12, None)}


def test_journal(spark):
    raw = spark.createDataFrame([("1", "BTC", -1.0), ("2", "BTC", -2.0), ("3", "BTC", 6.0), ("4", "BTC", -1.0)], "`Open Time` string, Pair string, Profit double")
    r = J.review(J.mapped(raw), ["symbol"]).first()
    assert (r.trades, r.win_pct, r.profit_factor, r.expectancy, r.max_losses) == (4, 25.0, 1.5, 0.5, 2)
