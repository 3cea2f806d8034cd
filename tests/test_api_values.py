"""Figures of the endpoints: each block against SQL that was written apart from them."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barlattice import api
from barlattice.sources import market as M
from barlattice.sources import pages as P
from barlattice.sources import store as L

SF, WIDE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def tables(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


@pytest.fixture(scope="module")
def duck():
    return tables(SF)


@pytest.fixture(scope="module")
def market(spark):
    return api.Market(M.ticks(spark, SF))


@pytest.fixture(scope="module")
def wide_duck():
    return tables(WIDE)


@pytest.fixture(scope="module")
def wide(spark):
    """A market with enough days of each symbol for every statistic."""
    return api.Market(M.ticks(spark, WIDE))


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, str)):
        return str(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    return float(f"{float(x):.9g}")


def assert_rows(df, duck, sql, where="true", columns=None, some=True):
    want = duck.execute(f"SELECT * FROM ({__spark_entry__.oracle_sql()[sql]}) WHERE {where}")
    names = columns or [d[0] for d in want.description]
    at = [[d[0] for d in want.description].index(n) for n in names]
    expected = sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())
    got = sorted(str([plain(r[n]) for n in names]) for r in df.collect())
    assert got == expected and (expected or not some)


#: Endpoint's block to the SQL with its rows, all history being shorter than what is asked.
BLOCKS = {
    "compute_session_stats": {"sessions": "k07_ranges", "sweeps": "k07_sweeps", "ny_continuation": "k07_continuation", "power_of_3": "k07_power_of_three", "day_of_week": "k07_weekdays"},
    "compute_pdh_pdl_stats": {"sides": "k13_sides", "outcomes": "k13_outcomes", "day_of_week": "k13_weekdays"},
    "compute_ib_stats": {"breakouts": "d15_breakouts", "extension": "d15_extension", "day_of_week": "d15_weekdays"},
    "compute_orb_stats": {"breakouts": "d16_breakouts", "extension": "d16_extension", "day_of_week": "d16_weekdays"},
    "compute_day_type_stats": {"regimes": "d18_regimes", "day_of_week": "d18_weekdays"},
    "compute_session_extension_stats": {"session_ranges": "d20_session_ranges", "extensions": "d19_grid", "daily_direction": "d21_directions", "hod_lod": "d22_extremes"},
    "compute_peak_points_stats": {"matrix": "d24_matrix", "marginals": "d24_marginals"},
    "compute_eth_profile_stats": {"touch": "d17_touches", "extension": "d17_extension", "day_of_week": "d17_weekdays"},
}


@pytest.mark.parametrize("endpoint", BLOCKS)
def test_statistics(wide, wide_duck, endpoint):
    out = getattr(wide, endpoint)()
    for block, sql in BLOCKS[endpoint].items():
        assert_rows(out[block], wide_duck, sql)


def test_symbols_of_too_few_days_have_no_row(market, duck):
    days = {r.symbol: r.n for r in market.compute_ib_stats()["days"].groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    all_days = dict(duck.execute(f"SELECT symbol, n FROM ({__spark_entry__.oracle_sql()['d15_breakouts']})").fetchall())
    assert days == {s: n for s, n in all_days.items() if n >= api.LEAST_WIDE_DAYS} and len(days) < len(all_days)


def test_session_card(wide, wide_duck):
    market, duck = wide, wide_duck
    card = market.get_session_card(" London ")
    own = "session = 'london'"
    for block, sql in (("direction", "d23_directions"), ("hod_lod", "d22_extremes"), ("timing", "d25_windows"), ("breakouts", "d19_grid"), ("extension", "d20_session_ranges")):
        assert_rows(card[block], duck, sql, own)
    assert market.get_session_card("asia")["breakouts"] is None


def test_candles_and_patterns(market, duck):
    assert_rows(market.get_candles("15m", 200), duck, "a11_latest_bars")
    assert_rows(market.get_price_action("1h", 500)["summary"], duck, "d31_summary")
    found = market.get_price_action("15m", 1000)["patterns"].groupBy("pattern", "span").agg(F.count("*").alias("n"), F.max("bar_ts").alias("newest"))
    assert_rows(found, duck, "pa04_counts")


def test_structure(market, duck):
    out = market.analyze_smc("15m", 1000)
    for block, sql in (("order_blocks", "smc04_order_blocks"), ("fair_value_gaps", "smc03_gaps"), ("swing_labels", "smc06_swing_labels"), ("fractals", "smc07_fractals"), ("liquidity_sweeps", "smc08_sweeps"), ("sweep_areas", "smc09_sweep_areas"), ("breaker_blocks", "smc10_breakers"), ("candle_trends", "smc11_trends"), ("range", "smc12_range")):
        assert_rows(out[block], duck, sql, some=block in ("fractals", "swing_labels", "candle_trends"))
    assert_rows(market.get_levels(), duck, "lvl01_levels")


def test_profile_and_flow(market, duck):
    p = market.get_market_profile("15m", 1000)
    assert_rows(p["profiles"], duck, "tpo06_value_area")
    rows = p["rows"].select(*[c if c != "count" else F.col("count").alias("n") for c in p["rows"].columns])
    assert_rows(rows, duck, "tpo05_zones")
    flow = market.get_orderflow("1h", 50)
    newest = market.trades.groupBy("symbol").agg(F.date_trunc("hour", F.max("ts")).alias("newest")).collect()
    since = {r.symbol: r.newest - datetime.timedelta(hours=49) for r in newest}
    keep = " OR ".join(f"(symbol = '{s}' AND bar_ts >= TIMESTAMP '{t}')" for s, t in since.items())
    assert_rows(flow["levels"], duck, "of01_levels", keep)
    assert_rows(flow["large_trades"], duck, "of03_large", keep)
    assert_rows(flow["deltas"], duck, "of02_delta", keep, ["symbol", "bar_ts", "buy", "sell", "delta"])


def test_volatility_correlation_and_grades(wide, wide_duck):
    market, duck = wide, wide_duck
    assert_rows(market.get_volatility("1h")["state"], duck, "vol01_state")
    assert_rows(market.get_volatility("1h")["adr"].withColumn("day", F.col("day").cast("string")), duck, "e16_adr_used")
    symbols = ["click", "view", "error", "purchase", "signup"]
    assert_rows(market.get_correlations(symbols, "click", "1h", 1000)["matrix"], duck, "cor01_matrix", "n >= 20")
    assert_rows(market.get_correlations(symbols, "click", "1h", 1000)["base"], duck, "f04_ranked_read", "n >= 20")
    assert_rows(market.scan_confluence(), duck, "cnf01_grades")
    assert_rows(market.get_adr_ratio(60), duck, "cnf04_adr_ratio")


def test_ict_and_bias(market, duck):
    out = market.get_ict_concepts("1h")
    dated = lambda df: df.withColumn("day", F.col("day").cast("string")) if "day" in df.columns else df
    for block, sql in (("draw_on_liquidity", "ict01_draw"), ("phases", "ict02_phases"), ("judas_swings", "ict03_judas"), ("session_bias", "ict04_session_bias")):
        assert_rows(dated(out[block]), duck, sql)
    bias = market.get_daily_bias()
    n = {r.symbol: r[1] for r in bias["entries"].groupBy("symbol").count().collect()}
    assert n and all(27 <= v <= 30 for v in n.values())


def test_structure_outcomes(market, duck):
    few = market.compute_smc_stats()["overall"]
    hours = {r.symbol: r.n for r in market.bars("1h").groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    assert {r.symbol for r in few.select("symbol").distinct().collect()} <= {s for s, n in hours.items() if n >= api.LEAST_SMC_BARS}


def test_backtests_and_edges(market):
    assert market.run_backtest()["valid_event_types"][0] == "asia_sweep"
    with pytest.raises(ValueError):
        market.run_backtest("moon")
    out = market.run_backtest("london_sweep", sweep_side="high", range_state="tight")
    events = api.X.session_events(market.bars("1h")).where("event_type = 'london_sweep' and side = 'high'").groupBy("symbol").count().collect()
    assert {r.symbol: r.n for r in out["matched"].collect()} == {r.symbol: r[1] for r in events}
    assert [r.note is None for r in out["matched"].collect()] == [r.n >= 5 for r in out["matched"].collect()]
    assert len(out["notes"]) == 1
    assert market.discover_edges()["edges"].count() == 0  # too few bars a symbol at this scale
    t = market.backtest_rr("session_range", stop_atr_mult=1.0, target_r=2.0)
    rs = [r.r for r in t["trades"].where("skip is null").orderBy("symbol", "bar_idx", "day", "session").collect()]
    stats = t["statistics"].collect()
    assert sum(s.trades for s in stats) == len(rs) and sum(s.wins for s in stats) == sum(r > 0 for r in rs)
    assert sum(s.total_r for s in stats) == pytest.approx(sum(rs), abs=1e-3)
    last = t["curve"].groupBy("symbol").agg(F.max_by("cum", "k").alias("cum")).collect()
    assert {r.symbol: round(r.cum, 3) for r in last} == {s.symbol: pytest.approx(s.total_r, abs=2e-3) for s in stats}


def test_forecast_of_an_older_day(wide, wide_duck):
    """Candles count back from the time asked for, not from the newest; trades after it don't count."""
    market, duck = wide, wide_duck
    for sql, at in (("fc01_forecast_london", "2024-01-20 05:00:00"), ("fc01_forecast_asia", "2024-01-20 22:00:00")):
        want = duck.execute(f"SELECT symbol, forecast_session, range_n, sweep_n FROM ({__spark_entry__.oracle_sql()[sql]}) ORDER BY 1").fetchall()
        got = market.get_session_forecast(days=60, as_of=at).orderBy("symbol").collect()
        assert [(r.symbol, r.forecast_session, r.range_n, r.sweep_n) for r in got] == want
    short = market.get_session_forecast(days=10, as_of="2024-01-20 05:00:00").collect()
    assert len(short) == 5 and all(r.range_n <= 10 for r in short)


def test_derivatives(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    funding = spark.createDataFrame([("BTCUSDT", 42000.0, 0.0001, day(20), day(19)), ("ETHUSDT", 2000.0, -0.0002, day(20), day(19))], "symbol string, mark_price double, rate double, next_ts timestamp_ntz, as_of timestamp_ntz")
    oi = spark.createDataFrame([("BTCUSDT", day(d), 100.0 + d, 5.0 * d) for d in range(1, 19)], "symbol string, ts timestamp_ntz, oi double, oi_value double")
    ratio = spark.createDataFrame([("BTCUSDT", day(1), 2.0), ("BTCUSDT", day(2), 1.0), ("ETHUSDT", day(2), 0.0)], "symbol string, ts timestamp_ntz, ratio double")
    out = api.get_derivatives(["BTCUSDT", "ETHUSDT"], funding, period="1d", limit=10, open_interest=oi, global_ratio=ratio)
    btc, eth = out["summary"].orderBy("symbol").collect()
    assert (btc.rate_pct, btc.annualized_pct, btc.next_funding_in_hours, btc.hours) == (0.01, 10.95, 24.0, 240.0)
    assert (btc.open_interest, btc.oi_value, btc.oi_change_pct, btc.oi_trend) == (118.0, 90.0, 8.2569, "rising")
    assert (btc.global_ratio, btc.global_trend, btc.taker_ratio, btc.taker_trend) == (1.0, "falling", None, None)
    assert (eth.open_interest, eth.oi_trend, eth.global_ratio, eth.global_trend, eth.hours) == (None, None, 0.0, None, 24.0)
    assert out["series"].where("series = 'open_interest'").count() == 10
    assert api.get_derivatives(["BTCUSDT"], funding, limit=9999, open_interest=oi)["series"].count() == 12
    with pytest.raises(ValueError):
        api.get_derivatives(["EUR_USD"], funding)
    with pytest.raises(ValueError):
        api.get_derivatives(["BTCUSDT"], funding, period="7h")


def test_bundles(market):
    out = market.analyze("click")
    assert out["gaps"] == ["derivatives: no positioning given"]
    assert {"higher", "structure", "levels", "market_profile", "orderflow", "confluence"} <= set(out)
    assert out["orderflow"]["deltas"].where("symbol <> 'click'").count() == 0
    brief = market.brief("click", "view")
    assert {"clock", "session_stats", "volatility", "correlations", "forecast"} <= set(brief) and brief["clock"].count() == 1
    assert "gaps" in brief and not any(g.startswith("correlations") for g in brief["gaps"])


# ---- the store --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return L.save(M.ticks(spark, SF), f"file://{tmp_path_factory.mktemp('store')}", buckets=4)


def scanned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_reads_the_days_that_it_needs(spark, store):
    m = api.Market.of(store)
    whole = api.Market(M.ticks(spark, SF))
    for timeframe, limit in (("1h", 20), ("5m", 3), ("1d", 2), ("1w", 2)):
        few = m.bars(timeframe, limit)
        assert sorted(few.collect()) == sorted(api.B.latest(whole.bars(timeframe), limit).collect())
    assert "PartitionFilters: [isnotnull(day" in scanned(m.bars("1h", 20)) and ">=" in scanned(m.bars("1h", 20))
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(store.newest(3600, 5)) < files(store.trades) / 2
    assert sorted(m.bars("1h", days=3).collect()) == sorted(whole.bars("1h", days=3).collect())
    assert "GreaterThanOrEqual(ts," in scanned(whole.bars("1h", 5))


def test_store_of_some_symbols_reads_their_buckets(store):
    one = store.only("click")
    assert {r.symbol for r in one.trades.select("symbol").distinct().collect()} == {"click"}
    assert "bucket" in scanned(one.trades).split("PartitionFilters: [")[1].split("]")[0]


def test_a_day_written_again_is_replaced(spark, store, tmp_path):
    ticks = M.ticks(spark, SF)
    path = f"file://{tmp_path}/again"
    early = L.save(ticks.where("ts < timestamp_ntz '2024-01-20 12:00:00'"), path, buckets=4)
    assert early.trades.count() < ticks.count()
    again = L.save(ticks.where("ts >= timestamp_ntz '2024-01-20 00:00:00'"), path, buckets=4)
    assert again.trades.select("trade_id").distinct().count() == again.trades.count() == ticks.count()
    assert sorted(map(str, again.index.drop("day").collect())) == sorted(map(str, store.index.drop("day").collect()))


def test_empty_store(spark, tmp_path):
    empty = L.save(M.ticks(spark, SF).where("false"), f"file://{tmp_path}/none")
    assert L.first_day(empty.index, 3600, 5) is None and empty.trades.count() == 0
    assert api.Market.of(empty).bars("1h", 5).count() == 0


# ---- saved pages and candles ------------------------------------------------------------------------


def test_pages(spark):
    rows = [
        ("A", 2, '[[1700000000000, "1", "2", "0.5", "1.5", "9", 0], [1700003600000, "3", "4", "2", "3", "8", 0]]'),
        ("A", 1, '[[1700000000000, "7", "8", "6", "7", "1", 0]]'), ("A", 3, '{"code": -1121}'), ("A", 4, None), ("A", 5, "[]"), ("A", 6, '[["x"], []]'),
    ]
    pages = spark.createDataFrame(rows, "symbol string, page long, payload string")
    got = {str(r.bar_ts): r.open for r in P.candles(pages).collect()}
    assert got == {"2023-11-14 22:13:20": 7.0, "2023-11-14 23:13:20": 3.0}
    assert sorted(r.page for r in P.rejected(pages).collect()) == [3, 4]
    raw = [("A", 1, '[{"a": 5, "p": "1.5", "q": "2", "T": 1700000000123, "m": true}, {"a": 5, "p": "1.5", "q": "2", "T": 1700000000123, "m": true}]'), ("A", 2, "oops")]
    (r,) = P.trades(spark.createDataFrame(raw, "symbol string, page long, payload string")).collect()
    assert (r.trade_id, r.price, r.qty, r.is_buyer_maker, str(r.ts)) == (5, 1.5, 2.0, True, "2023-11-14 22:13:20.123000")


def test_a_market_of_candles(spark, market):
    fine = api.Market.of_candles(market.bars("5m"), "M5")
    for timeframe, kw in (("5m", {"limit": 7}), ("1h", {}), ("1h", {"days": 5}), ("4h", {"limit": 9})):
        assert sorted(fine.bars(timeframe, **kw).collect()) == sorted(market.bars(timeframe, **kw).collect())
    assert fine.only("view").until("2024-01-10 00:00:00").bars("1h").agg(F.max("bar_ts")).first()[0] == datetime.datetime(2024, 1, 9, 20)
    for refused in (lambda: fine.bars("1m"), lambda: fine.get_orderflow("1h")):
        with pytest.raises(ValueError):
            refused()
