"""SQL for the queries of :mod:`queries_market`."""

from __future__ import annotations

from . import oracles_structure
from .oracles import ORACLES, sql

_WITHIN = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400}

def _ratio(yes: str) -> str:
    return f"count(*) FILTER ({yes}) / greatest(count(*) FILTER (NOT ({yes})), 1)"


_POSITIONING = f"""
WITH o AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, * FROM orders),
f AS (SELECT symbol, max(o_totalprice) AS mark_price, count(*) / 1e7 AS rate FROM o GROUP BY symbol),
e AS (SELECT symbol, ts, count(*)::DOUBLE AS oi, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS oi_value, {_ratio("o_orderstatus = 'F'")} AS g, {_ratio("o_totalprice > 150000")} AS t, {_ratio("o_custkey % 2 = 0")} AS k
      FROM o GROUP BY ALL),
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 30)
"""


def _trend(c: str) -> str:
    step = f"(arg_max({c}, ts) - arg_min({c}, ts)) / nullif(abs(arg_min({c}, ts)), 0) * 100"
    return f"CASE WHEN count(*) < 2 OR {step} IS NULL THEN NULL WHEN {step} > 1 THEN 'rising' WHEN {step} < -1 THEN 'falling' ELSE 'flat' END"


def _q4(x: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5) / 1e4"


ORACLES |= {
    "drv03_summary": _POSITIONING
    + f""", s AS (SELECT symbol, count(*) AS n, {_q4("arg_max(oi, ts)")} AS open_interest, {_q4("arg_max(oi_value, ts)")} AS oi_value, CASE WHEN count(*) >= 2 THEN {_q4("floor((arg_max(oi, ts) - arg_min(oi, ts)) * 100 / nullif(arg_min(oi, ts), 0) * 1e4 + 0.5) / 1e4")} END AS oi_change_pct,
        {_q4("arg_max(g, ts)")} AS global_ratio, {_q4("arg_max(t, ts)")} AS top_trader_ratio, {_q4("arg_max(k, ts)")} AS taker_ratio, {_trend("oi")} AS oi_trend, {_trend("g")} AS global_trend, {_trend("t")} AS top_trader_trend, {_trend("k")} AS taker_trend FROM d GROUP BY symbol)
    SELECT symbol, '1d' AS period, 24.0 * n AS hours, {_q4("mark_price")} AS mark_price, {_q4("rate")} AS rate, {_q4("floor(rate * 100 * 1e5 + 0.5) / 1e5")} AS rate_pct, {_q4("floor(rate * 3 * 365 * 100 * 1e3 + 0.5) / 1e3")} AS annualized_pct, 6.5 AS next_funding_in_hours,
        s.* EXCLUDE (symbol, n) FROM f JOIN s USING (symbol)""",
    "drv03_series": _POSITIONING
    + ", ".join([""] + [f"{name} AS (SELECT symbol, '{label}' AS series, ts, {c} AS value FROM d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 12)" for name, label, c in (("a", "open_interest", "oi"), ("b", "global", "g"), ("c", "taker", "k"))])
    + f" SELECT symbol, series, ts, {_q4('value')} AS value FROM (FROM a UNION ALL FROM b UNION ALL FROM c)",
    "a01_store_newest": sql("SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS nth FROM b5) WHERE nth <= 120"),
    "l01_journal_review": f"""WITH j AS (SELECT *, o_totalprice - 150000 AS pnl FROM orders),
        n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey, pnl) - row_number() OVER (PARTITION BY o_orderpriority, pnl < 0 ORDER BY o_orderdate, o_orderkey, pnl) AS island FROM j),
        r AS (SELECT o_orderpriority, max(c) AS m FROM (SELECT o_orderpriority, count(*) AS c FROM n WHERE pnl < 0 GROUP BY o_orderpriority, island) GROUP BY 1)
        SELECT o_orderpriority AS symbol, count(*) AS trades, floor(count(*) FILTER (pnl > 0) * 100.0 / count(*) * 10 + 0.5) / 10 AS win_pct, {_q4("sum(greatest(pnl, 0)) / nullif(-sum(least(pnl, 0)), 0)")} AS profit_factor, {_q4("avg(pnl)")} AS expectancy, any_value(coalesce(m, 0)) AS max_losses
        FROM j LEFT JOIN r USING (o_orderpriority) GROUP BY 1""",
    "l02_compliance": f"""SELECT o_orderstatus AS rule, count(*) AS trades, floor(count(*) FILTER (o_custkey % 3 <> 0) * 100.0 / count(*) * 10 + 0.5) / 10 AS kept_pct, {_q4("avg(o_totalprice - 150000) FILTER (o_custkey % 3 <> 0)")} AS avg_kept,
        {_q4("avg(o_totalprice - 150000) FILTER (o_custkey % 3 = 0)")} AS avg_broken FROM orders GROUP BY 1""",
    "l03_alignment": sql(
        """WITH d AS (SELECT symbol, date_trunc('day', bar_ts) AS day, arg_max(sign(close - open), bar_ts) AS h1, sign(arg_max(close, bar_ts) - arg_min(open, bar_ts)) AS d1 FROM b60 GROUP BY ALL),
        f AS (SELECT symbol, date_trunc('day', bar_ts) AS day, arg_max(sign(close - open), bar_ts) AS h4 FROM b240 GROUP BY ALL)
        SELECT symbol, strftime(day, '%Y-%m-%d') AS day, CASE WHEN h1 = h4 AND h4 = d1 AND h1 <> 0 THEN 'Full' WHEN greatest(h1, h4, d1) > 0 AND least(h1, h4, d1) < 0 THEN 'Conflict' ELSE 'Partial' END AS alignment FROM d JOIN f USING (symbol, day)"""
    ),
    "a10_kline_pages": sql("SELECT * FROM b5"),
    "a06_trade_pages": sql("SELECT symbol, date_trunc('second', ts)::TIMESTAMP AS ts, trade_id, price, qty, is_buyer_maker FROM ticks"),
    "a01_day_index": sql(
        "SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, "
        + ", ".join(f"count(DISTINCT epoch_ms(ts) // {s * 1000}) AS bars_{name}" for name, s in _WITHIN.items())
        + " FROM ticks GROUP BY ALL"
    ),
    "d05_price_quartiles": sql(
        """WITH b AS (SELECT symbol, price FROM ticks UNION ALL SELECT l_returnflag, l_extendedprice / l_quantity FROM lineitem)
        SELECT symbol, count(*) AS n, """ + ", ".join(f"floor(quantile_cont(price, {s}) * 1e4 + 0.5) / 1e4 AS {name}" for name, s in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))) + " FROM b GROUP BY symbol"
    ),
    "of02_trade_cvd": sql("SELECT symbol, trade_id, floor(sum(CASE WHEN is_buyer_maker THEN -qty ELSE qty END) OVER (PARTITION BY symbol ORDER BY ts, trade_id) * 1e6 + 0.5) / 1e6 AS cvd FROM ticks"),
    "smc15_appended": oracles_structure.ORACLES["smc15_outcomes"],
}
