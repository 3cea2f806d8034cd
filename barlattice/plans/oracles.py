"""DuckDB SQL for the registered queries, written apart from the Spark side.

``sql(body)`` puts before ``body`` the shared views that it names, and those
that they name in turn.
"""

from __future__ import annotations

import re

#: Shared views, each naming only views above it.
VIEWS: dict[str, str] = {
    "ticks": "SELECT event_type AS symbol, ts, event_id AS trade_id, 100.0::DOUBLE + value AS price, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS DOUBLE) AS qty, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS is_buyer_maker FROM events",
    **{
        name: f"SELECT symbol, time_bucket(INTERVAL '{width}', ts) AS bar_ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(qty) AS volume FROM ticks GROUP BY ALL"
        for name, width in (("b5", "5 minutes"), ("b15", "15 minutes"), ("b60", "1 hour"), ("b240", "4 hours"))
    },
    **{f"{b}i": f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS i FROM {b}" for b in ("b5", "b15", "b60")},
    "bd": """SELECT symbol, bar_ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(qty) AS volume
        FROM (SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS bar_ts, l_extendedprice / l_quantity AS price, l_quantity AS qty,
              row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) GROUP BY ALL""",
    "sb": """SELECT *, CASE WHEN h < 8 THEN 'asia' WHEN h < 13 THEN 'london' ELSE 'new_york' END AS session
        FROM (SELECT *, bar_ts::DATE AS day, hour(bar_ts) AS h FROM b60) WHERE h < 21""",
    "sr": """SELECT symbol, day, session, max(high) AS high, min(low) AS low, arg_min(open, bar_ts) AS open, arg_max(close, bar_ts) AS close,
        arg_min(bar_ts, row(-high, bar_ts)) AS hat, arg_min(bar_ts, row(low, bar_ts)) AS lat, count(*) AS n FROM sb GROUP BY ALL""",
    "dr": """SELECT symbol, day, max(high) AS day_high, min(low) AS day_low, arg_min(open, bar_ts) AS day_open, arg_max(close, bar_ts) AS day_close FROM sb GROUP BY ALL""",
    "wide": """SELECT dr.*, a.high AS ah, a.low AS al, a.open AS ao, a.close AS ac, l.high AS lh, l.low AS ll, l.open AS lo, l.close AS lc, n.high AS nh, n.low AS nl, n.open AS no, n.close AS nc
        FROM dr LEFT JOIN sr a ON a.symbol = dr.symbol AND a.day = dr.day AND a.session = 'asia' LEFT JOIN sr l ON l.symbol = dr.symbol AND l.day = dr.day AND l.session = 'london'
        LEFT JOIN sr n ON n.symbol = dr.symbol AND n.day = dr.day AND n.session = 'new_york'""",
    "vs": """SELECT c.*, p.high AS ph, p.low AS pl FROM sb c JOIN sr p ON p.symbol = c.symbol AND p.day = c.day AND p.session = CASE c.session WHEN 'london' THEN 'asia' WHEN 'new_york' THEN 'london' END""",
    "brk": """SELECT symbol, day, session, any_value(ph) AS ph, any_value(pl) AS pl, max(high) AS hh, min(low) AS ll, min(bar_ts) FILTER (high > ph) AS up, min(bar_ts) FILTER (low < pl) AS dn,
        arg_min(high, bar_ts) FILTER (high > ph) AS uh, arg_min(close, bar_ts) FILTER (high > ph) AS uc, arg_min(low, bar_ts) FILTER (low < pl) AS dl, arg_min(close, bar_ts) FILTER (low < pl) AS dc FROM vs GROUP BY symbol, day, session""",
    "swp": """SELECT symbol, day, session, CASE WHEN up IS NOT NULL AND dn IS NOT NULL THEN 'both' WHEN up IS NOT NULL THEN 'high' ELSE 'low' END AS swept_side,
        coalesce(uc < ph, false) OR coalesce(dc > pl, false) AS reversal, CASE WHEN dn IS NOT NULL AND (up IS NULL OR dn >= up) THEN dl ELSE uh END AS sweep_price,
        strftime(CASE WHEN dn IS NOT NULL AND (up IS NULL OR dn >= up) THEN dn ELSE up END, '%H:%M') AS sweep_time,
        CASE WHEN coalesce(uc < ph, false) AND coalesce(dc > pl, false) THEN CASE WHEN dn >= up THEN dc - dl ELSE uh - uc END WHEN coalesce(uc < ph, false) THEN uh - uc WHEN coalesce(dc > pl, false) THEN dc - dl ELSE 0 END AS dist
        FROM brk WHERE up IS NOT NULL OR dn IS NOT NULL""",
    "adr": "SELECT symbol, avg(day_high - day_low) AS adr FROM dr GROUP BY symbol",
    "p3": """SELECT *, CASE WHEN bull THEN fh - ah ELSE al - fl END AS dist FROM (SELECT *, CASE WHEN up AND dn THEN fc > (ah + al) / 2 ELSE dn END AS bull FROM (
        SELECT wide.*, adr, ah - al AS ar, lh > ah AS up, ll < al AS dn, greatest(lh, nh) AS fh, least(ll, nl) AS fl, coalesce(nc, lc) AS fc FROM wide JOIN adr USING (symbol) WHERE ah IS NOT NULL AND lh IS NOT NULL)
        WHERE ar < adr * 0.5 AND (up OR dn))""",
    "cd": "SELECT symbol, bar_ts::DATE AS day, arg_min(open, bar_ts) AS d_open, max(high) AS d_high, min(low) AS d_low, arg_max(close, bar_ts) AS d_close FROM b60 GROUP BY ALL",
    "tr": """SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY i) AS pc FROM b60i)""",
    "ret": "SELECT *, CASE WHEN pc > 0 AND close > 0 THEN ln(close / pc) END AS r FROM tr",
    "bbw": """SELECT *, CASE WHEN i >= 19 AND m > 0 THEN floor(4.0 * sd / m * 1e6 + 0.5) / 1e6 END AS width FROM (SELECT *, avg(close) OVER w AS m, stddev_pop(close) OVER w AS sd FROM b60i
        WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING))""",
    "sqz": """SELECT a.symbol, a.i, any_value(a.bar_ts) AS bar_ts, any_value(a.width) AS width, floor(count(*) FILTER (b.width <= a.width) / count(*) * 100 * 1e4 + 0.5) / 1e4 AS p FROM bbw a JOIN bbw b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 99 AND a.i AND b.width IS NOT NULL
        WHERE a.width IS NOT NULL GROUP BY a.symbol, a.i""",
    "pdh": """SELECT d.*, min(b.bar_ts) FILTER (b.high >= pdh) AS up, min(b.bar_ts) FILTER (b.low <= pdl) AS dn FROM (SELECT symbol, day, d_close, lag(d_high) OVER w AS pdh, lag(d_low) OVER w AS pdl FROM cd WINDOW w AS (PARTITION BY symbol ORDER BY day)) d
        JOIN b60 b ON b.symbol = d.symbol AND b.bar_ts::DATE = d.day WHERE pdh IS NOT NULL GROUP BY ALL""",
    "pdf": """SELECT symbol, CAST(day AS VARCHAR) AS day, pdh, pdl, d_close AS day_close, up IS NOT NULL AS touched_pdh, dn IS NOT NULL AS touched_pdl,
        CASE WHEN up IS NOT NULL AND dn IS NOT NULL THEN 'both' WHEN up IS NOT NULL THEN 'pdh_only' WHEN dn IS NOT NULL THEN 'pdl_only' ELSE 'neither' END AS outcome,
        strftime(up, '%H:%M') AS pdh_touch_time, strftime(dn, '%H:%M') AS pdl_touch_time, up IS NOT NULL AND d_close < pdh AS pdh_reversal, up IS NOT NULL AND d_close >= pdh AS pdh_held,
        dn IS NOT NULL AND d_close > pdl AS pdl_reversal, dn IS NOT NULL AND d_close <= pdl AS pdl_held, dayname(day) AS day_of_week FROM pdh""",
    "ibw": """SELECT symbol, bar_ts::DATE AS day, hour(bar_ts) * 60 + minute(bar_ts) AS m, bar_ts, open, high, low, close, '5m' AS source FROM b5
        UNION ALL SELECT symbol, bar_ts::DATE, hour(bar_ts) * 60 + minute(bar_ts), bar_ts, open, high, low, close, '1H' FROM b60""",
    "ibs": """SELECT symbol, day, CASE WHEN count(*) FILTER (source = '5m') > 0 THEN '5m' ELSE '1H' END AS source FROM ibw WHERE m >= 810 AND m < 870 GROUP BY ALL""",
    "ibr": """SELECT symbol, day, source, max(high) FILTER (m < 870) AS ih, min(low) FILTER (m < 870) AS il, arg_min(open, bar_ts) AS o, arg_max(close, bar_ts) AS c, count(*) FILTER (m < 870) AS n_ib, count(*) FILTER (m >= 870) AS n_after,
        max(high) FILTER (m >= 870) AS ph, min(low) FILTER (m >= 870) AS pl FROM ibw SEMI JOIN ibs USING (symbol, day, source) WHERE m >= 810 AND m < 1200 GROUP BY ALL HAVING count(*) FILTER (m < 870) > 0""",
    "ib": """SELECT r.*, min(bar_ts) FILTER (high > ih) AS up, min(bar_ts) FILTER (low < il) AS dn, arg_min(w.close >= w.open, bar_ts) FILTER (high > ih AND low < il) AS su
        FROM ibr r LEFT JOIN ibw w ON w.symbol = r.symbol AND w.day = r.day AND w.source = r.source AND w.m >= 870 AND w.m < 1200 GROUP BY ALL""",
    "ibf": """SELECT symbol, CAST(day AS VARCHAR) AS day, ih AS ib_high, il AS ib_low, floor((ih - il) * 1e6 + 0.5) / 1e6 AS ib_size, floor((ih - il) / il * 100 * 1e3 + 0.5) / 1e3 AS ib_size_pct,
        floor(ue * 1e6 + 0.5) / 1e6 AS up_extension, floor(de * 1e6 + 0.5) / 1e6 AS down_extension, floor(greatest(ue, de) * 1e6 + 0.5) / 1e6 AS max_extension,
        CASE WHEN greatest(ue, de) > 0 THEN floor((ih - il) / greatest(ue, de) * 1e3 + 0.5) / 1e3 END AS size_to_extension,
        CASE WHEN up IS NOT NULL AND dn IS NOT NULL THEN 'both' WHEN up IS NOT NULL THEN 'only_h' WHEN dn IS NOT NULL THEN 'only_l' ELSE 'neither' END AS outcome,
        CASE WHEN up = dn THEN CASE WHEN su THEN 'high' ELSE 'low' END WHEN up IS NOT NULL AND (dn IS NULL OR up < dn) THEN 'high' WHEN dn IS NOT NULL THEN 'low' END AS first_break_side,
        strftime(least(up, dn), '%H:%M') AS first_break_time, CASE WHEN c >= o THEN 'long' ELSE 'short' END AS day_direction, dayname(day) AS day_of_week, source, n_ib, n_after
        FROM (SELECT *, greatest(coalesce(ph, ih) - ih, 0) AS ue, greatest(il - coalesce(pl, il), 0) AS de FROM ib)""",
    "orr": """SELECT symbol, day, max(high) FILTER (m < 825) AS oh, min(low) FILTER (m < 825) AS ol, count(*) FILTER (m < 825) AS n_orb, max(high) FILTER (m >= 825) AS ph, min(low) FILTER (m >= 825) AS pl
        FROM ibw WHERE source = '5m' AND m >= 810 AND m < 1200 GROUP BY ALL HAVING count(*) FILTER (m < 825) > 0""",
    "orx": "SELECT r.*, min(bar_ts) FILTER (high >= oh) AS up, min(bar_ts) FILTER (low <= ol) AS dn FROM orr r LEFT JOIN ibw w ON w.symbol = r.symbol AND w.day = r.day AND w.source = '5m' AND w.m >= 825 AND w.m < 1200 GROUP BY ALL",
    "orf": """SELECT symbol, CAST(day AS VARCHAR) AS day, oh AS orb_high, ol AS orb_low, floor((oh - ol) * 1e6 + 0.5) / 1e6 AS orb_size, floor(greatest(coalesce(ph, oh) - oh, 0) * 1e6 + 0.5) / 1e6 AS up_extension,
        floor(greatest(ol - coalesce(pl, ol), 0) * 1e6 + 0.5) / 1e6 AS down_extension, CASE WHEN up IS NOT NULL AND (dn IS NULL OR up <= dn) THEN 'high' WHEN dn IS NOT NULL THEN 'low' END AS first_break_side,
        strftime(least(up, dn), '%H:%M') AS first_break_time, CASE WHEN up IS NOT NULL AND dn IS NOT NULL THEN 'both' WHEN up IS NOT NULL THEN 'only_h' WHEN dn IS NOT NULL THEN 'only_l' ELSE 'neither' END AS outcome, dayname(day) AS day_of_week, n_orb FROM orx""",
    "dsum": """SELECT *, CASE WHEN ul >= dl THEN 'long' ELSE 'short' END AS direction, CASE day_high WHEN ah THEN 'asia' WHEN lh THEN 'london' WHEN nh THEN 'new_york' END AS hod, CASE day_low WHEN al THEN 'asia' WHEN ll THEN 'london' WHEN nl THEN 'new_york' END AS lod
        FROM (SELECT *, coalesce(ao, lo, no) AS f, greatest(day_high - coalesce(ao, lo, no), 0) AS ul, greatest(coalesce(ao, lo, no) - day_low, 0) AS dl FROM (SELECT symbol, day, day_high, day_low, ah, al, ao, lh, ll, lo, nh, nl, no FROM wide))""",
    "brf": """SELECT symbol, CAST(day AS VARCHAR) AS day, session, CASE WHEN up IS NOT NULL AND dn IS NOT NULL THEN 'both' WHEN up IS NOT NULL THEN 'only_h' WHEN dn IS NOT NULL THEN 'only_l' ELSE 'neither' END AS cell,
        CASE WHEN up <= dn THEN 'h_then_l' WHEN up > dn THEN 'l_then_h' END AS sequence, floor(CASE WHEN up IS NOT NULL OR dn IS NOT NULL THEN greatest(hh - ph, pl - ll) END * 1e6 + 0.5) / 1e6 AS overshoot,
        floor(CASE WHEN up IS NOT NULL OR dn IS NOT NULL THEN greatest(hh - ph, pl - ll) / nullif(ph - pl, 0) END * 1e4 + 0.5) / 1e4 AS overshoot_multiple, dayname(day) AS day_of_week FROM brk""",
    "pk": """SELECT symbol, day, arg_min(session, row(-high, strftime(hat, '%H:%M'), session)) AS hod_session, arg_min(session, row(low, strftime(lat, '%H:%M'), session)) AS lod_session,
        arg_min(strftime(hat, '%H:%M'), row(-high, strftime(hat, '%H:%M'), session)) AS hod_time, arg_min(strftime(lat, '%H:%M'), row(low, strftime(lat, '%H:%M'), session)) AS lod_time, max(high) AS day_high, min(low) AS day_low,
        CASE WHEN greatest(coalesce(max(close - open), 0), 0) >= greatest(coalesce(max(open - close), 0), 0) THEN 'bullish' ELSE 'bearish' END AS net_direction FROM sr GROUP BY ALL""",
    "dt": """SELECT w.symbol, w.day, w.ah, w.al, w.ao, w.ac, w.lh, w.ll, w.lo, w.lc, w.nh, w.nl, w.no, w.nc, c.*EXCLUDE (symbol, day), a.swept_side AS aside, a.reversal AS arev, l.swept_side AS lside, CASE WHEN p3.bull THEN 'bullish' ELSE 'bearish' END AS p3dir, p3.up AS p3up, p3.dn AS p3dn, p3.symbol IS NOT NULL AS has_p3,
        CASE WHEN d_close > d_open THEN 'bullish' WHEN d_close < d_open THEN 'bearish' ELSE 'neutral' END AS net,
        CASE d_high WHEN w.ah THEN 'asia' WHEN w.lh THEN 'london' WHEN w.nh THEN 'new_york' END AS hod, CASE d_low WHEN w.al THEN 'asia' WHEN w.ll THEN 'london' WHEN w.nl THEN 'new_york' END AS lod,
        coalesce(a.swept_side IN ('high', 'both'), false) AS axh, coalesce(a.swept_side IN ('low', 'both'), false) AS axl, coalesce(l.swept_side IN ('high', 'both'), false) AS lxh, coalesce(l.swept_side IN ('low', 'both'), false) AS lxl,
        coalesce((w.lc > w.lo) = (w.nc > w.no), false) AS cont
        FROM wide w JOIN (SELECT *, CASE WHEN k >= 5 AND med > 0 THEN size / med ELSE 1.0 END AS x FROM (SELECT *, d_high - d_low AS size, lag(d_high) OVER o AS qh, lag(d_low) OVER o AS ql, count(*) OVER p AS k, quantile_cont(d_high - d_low, 0.5) OVER p AS med FROM cd
          WINDOW o AS (PARTITION BY symbol ORDER BY day), p AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))) c ON c.symbol = w.symbol AND c.day = w.day
        LEFT JOIN swp a ON a.symbol = w.symbol AND a.day = w.day AND a.session = 'london' LEFT JOIN swp l ON l.symbol = w.symbol AND l.day = w.day AND l.session = 'new_york' LEFT JOIN p3 ON p3.symbol = w.symbol AND p3.day = w.day""",
    "dtf": """SELECT *, CASE WHEN archetype LIKE '%continuation' THEN 'trend' WHEN archetype LIKE '%reversal' THEN 'london_reverse' WHEN archetype LIKE 'power%' OR archetype LIKE 'double%' THEN 'high_volatile' ELSE 'rare' END AS regime FROM (
        SELECT *, CASE WHEN d_high < qh AND d_low > ql THEN 'inside_day' WHEN d_high > qh AND d_low < ql THEN 'outside_day'
        WHEN has_p3 AND p3dir = 'bullish' AND p3dn THEN 'power_of_3_long' WHEN has_p3 AND p3dir = 'bearish' AND p3up THEN 'power_of_3_short'
        WHEN net <> 'neutral' AND x >= 1.3 AND ah - al > 0 AND lh IS NOT NULL AND size >= 2 * (ah - al) AND axl AND net = 'bullish' THEN 'power_of_3_long'
        WHEN net <> 'neutral' AND x >= 1.3 AND ah - al > 0 AND lh IS NOT NULL AND size >= 2 * (ah - al) AND axh AND net = 'bearish' THEN 'power_of_3_short'
        WHEN (axh OR axl) AND (lxh OR lxl) THEN 'double_sweep_expansion'
        WHEN arev AND axh AND net = 'bearish' THEN 'asia_high_london_reversal' WHEN arev AND axl AND net = 'bullish' THEN 'asia_low_london_reversal'
        WHEN CASE WHEN ac > ao THEN 'bullish' WHEN ah IS NOT NULL THEN 'bearish' END = net AND cont AND NOT (axh AND net = 'bearish') AND NOT (axl AND net = 'bullish') THEN 'asia_breakout_continuation'
        WHEN CASE WHEN lc > lo THEN 'bullish' WHEN lh IS NOT NULL THEN 'bearish' END = net AND cont AND (lh - ll) / ll > 0 THEN 'london_breakout_continuation'
        WHEN (nc > no) = (lc > lo) AND (nh - nl) / nl * 100 >= (lh - ll) / ll * 100 AND (coalesce(hod = 'new_york', false) OR coalesce(lod = 'new_york', false)) THEN 'ny_breakout_continuation' ELSE 'consolidation_drift' END AS archetype FROM dt)""",
}


def sql(body: str) -> str:
    """``body`` after a WITH of all shared views that it needs."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\b(\w+)\b", text):
            if name in VIEWS and name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                add(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    add(body)
    inner = body.lstrip()
    if not needed:
        return inner
    views = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed)
    if inner.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {inner[15:]}"
    if inner.upper().startswith("WITH "):
        return f"WITH {views}, {inner[5:]}"
    return f"WITH {views} {inner}"


def r(x: str, places: int = 6) -> str:
    """Half-up on the scaled value."""
    return f"floor(({x}) * 1e{places} + 0.5) / 1e{places}"


def pct(part: str, whole: str) -> str:
    return f"coalesce({r(f'({part}) * 100.0 / nullif(({whole})::DOUBLE, 0)', 1)}, 0)"


def dist(x: str, places: int = 6, p: str = "") -> str:
    quartiles = ", ".join(f"{r(f'quantile_cont({x}, {f})', places)} AS {p}{n}" for n, f in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)))
    return (
        f"count({x}) AS {p}n, {r(f'avg({x})', places)} AS {p}mean, {r(f'min({x})', places)} AS {p}min, {r(f'max({x})', places)} AS {p}max, {quartiles}, "
        f"CASE WHEN count({x}) < 10 THEN 'insufficient' WHEN count({x}) < 30 THEN 'low' WHEN count({x}) < 100 THEN 'normal' ELSE 'high' END AS {p}confidence"
    )


_RANGES = f"""SELECT *, {r('high - low')} AS range, {r('(high - low) / low * 100', 3)} AS range_pct, CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END AS direction FROM sr"""


def _sweep_rates(by: str) -> str:
    return f"""WITH d AS (SELECT c.symbol, c.day, c.session, dayname(c.day) AS day_of_week FROM sr c JOIN sr p ON p.symbol = c.symbol AND p.day = c.day AND p.session = CASE c.session WHEN 'london' THEN 'asia' WHEN 'new_york' THEN 'london' END)
        SELECT {by}, count(*) AS days, count(swept_side) AS sweeps, {pct('count(swept_side)', 'count(*)')} AS sweep_pct, {pct("count(*) FILTER (swept_side = 'high')", 'count(swept_side)')} AS high_pct,
        {pct("count(*) FILTER (swept_side = 'low')", 'count(swept_side)')} AS low_pct, {pct("count(*) FILTER (swept_side = 'both')", 'count(swept_side)')} AS both_pct, {pct('count(*) FILTER (reversal)', 'count(swept_side)')} AS reversal_pct,
        {r(f'avg({r("dist")})', 4)} AS avg_distance FROM d LEFT JOIN swp USING (symbol, day, session) GROUP BY {by}"""


def _returns(body: str) -> str:
    return f"""WITH t AS (SELECT bar_ts FROM b60 GROUP BY bar_ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM b60)),
        x AS (SELECT symbol, row_number() OVER w - 1 AS i, close, lag(close) OVER w AS pc FROM b60 SEMI JOIN t USING (bar_ts) WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
        y AS (SELECT symbol, i, coalesce(ln(close / pc), 0) AS v FROM x WHERE i > 0),
        z AS (SELECT p.symbol AS a, q.symbol AS b, p.i - 1 AS i, p.v AS x, q.v AS y FROM y p JOIN y q ON p.i = q.i AND p.symbol < q.symbol) {body}"""


_R = f"CASE WHEN count(*) >= 3 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN {r('greatest(-1, least(1, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))))', 4)} ELSE 0 END"
_OUT4 = ("only_h", "only_l", "both", "neither")

ORACLES: dict[str, str] = {
    "a13_bars_1h": sql("SELECT * FROM b60"),
    "a13_bars_5m": sql("SELECT * FROM b5"),
    "a13_bars_daily": sql(f"SELECT * REPLACE ({r('volume', 4)} AS volume) FROM bd"),
    "a11_latest_bars": sql("SELECT *, strftime(bar_ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM b15 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) <= 200"),
    "a02_range_scan": sql("SELECT * FROM b60 WHERE bar_ts >= TIMESTAMP '2024-01-05' AND bar_ts < TIMESTAMP '2024-01-12' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) <= 100"),
    "a05_venue": "SELECT symbol, CASE WHEN contains(symbol, '_') THEN 'fx' ELSE 'crypto' END AS venue FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN left(n_name, 3) || '_USD' ELSE n_name || 'USDT' END AS symbol FROM nation)",
    "a06_trade_scan": sql("SELECT symbol, ts, trade_id, price, qty, is_buyer_maker FROM ticks WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11'"),
    "b01_geometry": sql(f"SELECT symbol, bar_ts, {r('abs(close - open)')} AS body, {r('high - low')} AS range, {r('high - greatest(open, close)')} AS upper_wick, {r('least(open, close) - low')} AS lower_wick, close > open AS bull, CASE WHEN high > low THEN {r('abs(close - open) / (high - low)')} ELSE 0 END AS body_ratio FROM b60"),
    "b06_sessions": sql("SELECT symbol, session, count(*) AS n, count(DISTINCT day) AS days FROM sb GROUP BY ALL"),
    "c01_align": sql("SELECT bar_ts, " + ", ".join(f"max(close) FILTER (symbol = '{s}') AS {s}" for s in ("click", "error", "purchase", "signup", "view")) + " FROM b60 GROUP BY bar_ts HAVING count(*) = 5"),
    "c03_asof_daily": sql("SELECT t.symbol, t.ts, t.trade_id, t.price, d.d_close FROM ticks t ASOF LEFT JOIN cd d ON t.symbol = d.symbol AND t.ts > d.day::TIMESTAMP"),
    "d01_session_range": sql(f"SELECT symbol, CAST(day AS VARCHAR) AS day, session, high, low, open, close, strftime(hat, '%H:%M') AS high_time, strftime(lat, '%H:%M') AS low_time, n AS n_bars, range, range_pct, direction, dayname(day) AS day_of_week FROM ({_RANGES})"),
    "d02_calendar_days": sql("SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM cd"),
    "d03_adr": sql(f"SELECT symbol, {r('avg(day_high - day_low)')} AS adr, count(*) AS days FROM dr GROUP BY symbol"),
    "d05_range_distribution": sql(f"SELECT session, {dist('range', 7)} FROM ({_RANGES}) GROUP BY session"),
    "d06_session_summary": sql(f"""SELECT symbol, session, count(*) AS n, {r('avg(range)')} AS avg_range, {r('avg((high - low) / low * 100)', 3)} AS avg_range_pct, {pct("count(*) FILTER (direction = 'bullish')", 'count(*)')} AS bullish_pct FROM ({_RANGES}) GROUP BY ALL"""),
    "d07_sweep_rates": sql(_sweep_rates("symbol, session")),
    "d08_ny_continuation": sql(f"SELECT symbol, count(*) AS days, count(*) FILTER ((lc > lo) = (nc > no)) AS continued, {pct('count(*) FILTER ((lc > lo) = (nc > no))', 'count(*)')} AS continuation_pct, {r(f'avg({r("nh - nl")})')} AS avg_ny_range FROM wide WHERE lh IS NOT NULL AND nh IS NOT NULL GROUP BY symbol"),
    "d09_power_of_three": sql(f"""SELECT symbol, days, coalesce(n, 0) AS n, coalesce(s, 0) AS succeeded, {pct('coalesce(n, 0)', 'days')} AS occurrence_pct, {pct('coalesce(s, 0)', 'coalesce(n, 0)')} AS success_pct, a AS avg_distance
        FROM (SELECT symbol, count(*) AS days FROM dr GROUP BY symbol) LEFT JOIN (SELECT symbol, count(*) AS n, count(*) FILTER (dist > ar * 1.5) AS s, {r(f'avg({r("dist")})', 4)} AS a FROM p3 GROUP BY symbol) USING (symbol)"""),
    "d10_weekday_sweeps": sql(_sweep_rates("session, day_of_week")),
    "e01_true_range": sql("SELECT symbol, bar_ts, tr FROM tr"),
    "e02_atr": sql(f"SELECT symbol, bar_ts, CASE WHEN i >= 14 THEN {r('avg(tr) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING)')} END AS atr FROM tr"),
    "e03_atr_entry": sql(f"""SELECT a.symbol, a.bar_ts, {r('avg(CASE WHEN b.i = greatest(a.i - 13, 0) THEN b.high - b.low ELSE b.tr END)')} AS atr_entry FROM tr a JOIN tr b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 13 AND a.i GROUP BY a.symbol, a.bar_ts"""),
    "e04_wilder": sql(f"""WITH RECURSIVE t AS (SELECT symbol, i, coalesce(tr, high - low) AS v FROM tr), w(symbol, i, a) AS (
        SELECT symbol, 199, avg(v) FROM t WHERE i < 200 GROUP BY symbol HAVING count(*) = 200 UNION ALL SELECT w.symbol, t.i, (w.a * 199 + t.v) / 200 FROM w JOIN t ON t.symbol = w.symbol AND t.i = w.i + 1)
        SELECT symbol, i AS bar_idx, {r('a')} AS wilder FROM w"""),
    "e05_log_returns": sql(f"SELECT symbol, bar_ts, {r('r', 9)} AS log_return FROM ret"),
    "e06_realized_vol": sql(f"SELECT symbol, bar_ts, CASE WHEN i >= 30 THEN {r('stddev_samp(r) OVER (PARTITION BY symbol ORDER BY i ROWS 29 PRECEDING) * sqrt(8760) * 100', 4)} END AS realized_vol FROM ret"),
    "e07_band_width": sql("SELECT symbol, bar_ts, width FROM bbw"),
    "e08_squeeze": sql("SELECT symbol, bar_ts, p AS squeeze_pct FROM sqz"),
    "e14_prior_median": sql(f"SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN count(*) OVER w >= 5 THEN {r('quantile_cont(d_high - d_low, 0.5) OVER w')} END AS prior_median FROM cd WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"),
    "e16_adr_used": sql(f"""SELECT symbol, CAST(day AS VARCHAR) AS day, {r('s')} AS today_range, {r('a')} AS adr, {r('s / a * 100', 4)} AS used_pct FROM (SELECT symbol, day, day_high - day_low AS s, avg(day_high - day_low) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS a FROM dr)
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) = 1"""),
    "vol01_state": sql(f"""SELECT symbol, bar_ts, a14 AS atr14, a50 AS atr50, v AS realized_vol, width, p AS squeeze_pct, CASE WHEN p <= 25 THEN 'contracting' WHEN a14 / a50 >= 1.15 THEN 'expanding' WHEN a14 / a50 <= 0.85 THEN 'contracting' ELSE 'neutral' END AS state
        FROM (SELECT symbol, i, {r('avg(tr) OVER (w ROWS 13 PRECEDING)')} AS a14, {r('avg(tr) OVER (w ROWS 49 PRECEDING)')} AS a50, {r('stddev_samp(r) OVER (w ROWS 29 PRECEDING) * sqrt(8760) * 100', 4)} AS v FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY i)) JOIN sqz USING (symbol, i)
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1"""),
    "cor01_matrix": sql(_returns(f"SELECT a, b, count(*) AS n, {_R} AS r FROM z GROUP BY a, b")),
    "cor02_base": sql(_returns(f"""SELECT other, n, r, r_prior, r_recent, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
        CASE WHEN r >= 0.1 THEN 'same' WHEN r <= -0.1 THEN 'opposite' ELSE 'none' END AS direction, CASE WHEN r_recent - r_prior > 0.15 THEN 'tightening' WHEN r_recent - r_prior < -0.15 THEN 'decoupling' ELSE 'stable' END AS shift
        FROM (SELECT o AS other, count(*) AS n, {_R} AS r FROM (SELECT *, CASE WHEN a = 'click' THEN b ELSE a END AS o FROM z WHERE 'click' IN (a, b)) GROUP BY o)
        JOIN (SELECT o AS other, {_R} AS r_prior FROM (SELECT *, CASE WHEN a = 'click' THEN b ELSE a END AS o, count(*) OVER (PARTITION BY a, b) AS m FROM z WHERE 'click' IN (a, b)) WHERE i < m // 2 GROUP BY o) USING (other)
        JOIN (SELECT o AS other, {_R} AS r_recent FROM (SELECT *, CASE WHEN a = 'click' THEN b ELSE a END AS o, count(*) OVER (PARTITION BY a, b) AS m FROM z WHERE 'click' IN (a, b)) WHERE i >= m // 2 GROUP BY o) USING (other)""")),
    "d31_summary": sql(f"""SELECT symbol, count(*) AS n, count(*) FILTER (close > open) AS bullish, count(*) FILTER (close < open) AS bearish, {r('avg(CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END)')} AS avg_body_ratio,
        {r('(arg_max(close, bar_ts) - arg_min(open, bar_ts)) / arg_min(open, bar_ts) * 100')} AS net_pct FROM (SELECT * FROM b60 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) <= 20) GROUP BY symbol"""),
    "ses01_sweeps": sql(f"SELECT symbol, CAST(day AS VARCHAR) AS day, session, swept_side, reversal, sweep_price, sweep_time, {r('dist')} AS reversal_distance, dayname(day) AS day_of_week FROM swp"),
    "ses02_continuation": sql(f"""SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN lc > lo THEN 'bullish' ELSE 'bearish' END AS london_direction, CASE WHEN nc > no THEN 'bullish' ELSE 'bearish' END AS ny_direction, (lc > lo) = (nc > no) AS continuation,
        {r('lh - ll')} AS london_range, {r('nh - nl')} AS ny_range, dayname(day) AS day_of_week FROM wide WHERE lh IS NOT NULL AND nh IS NOT NULL"""),
    "ses03_power_of_three": sql(f"""SELECT symbol, CAST(day AS VARCHAR) AS day, {r('ar')} AS asia_range, {r('ar / adr * 100', 1)} AS asia_pct_of_adr, CASE WHEN up AND dn THEN 'both' WHEN up THEN 'high' ELSE 'low' END AS manipulation_side,
        CASE WHEN bull THEN 'bullish' ELSE 'bearish' END AS distribution_direction, {r('dist')} AS distribution_distance, dist > ar * 1.5 AS success, dayname(day) AS day_of_week FROM p3"""),
    "pdh01_touch": sql("SELECT * FROM pdf"),
    "d14_prior_day": sql("SELECT symbol, count(*) AS days, " + ", ".join(f"{pct(f'count(*) FILTER ({c})', w)} AS {n}" for n, c, w in (
        ("pdh_pct", "touched_pdh", "count(*)"), ("pdl_pct", "touched_pdl", "count(*)"), ("both_pct", "outcome = 'both'", "count(*)"), ("neither_pct", "outcome = 'neither'", "count(*)"),
        ("pdh_reversal_pct", "pdh_reversal", "count(*) FILTER (touched_pdh)"), ("pdh_held_pct", "pdh_held", "count(*) FILTER (touched_pdh)"), ("pdl_reversal_pct", "pdl_reversal", "count(*) FILTER (touched_pdl)"), ("pdl_held_pct", "pdl_held", "count(*) FILTER (touched_pdl)"))) + " FROM pdf GROUP BY symbol"),
    "ib01_days": sql("SELECT * FROM ibf"),
    "d15_initial_balance": sql("SELECT day_of_week, count(*) AS days, " + ", ".join(pct(f"count(*) FILTER (outcome = '{o}')", "count(*)") + f" AS {o}_pct" for o in _OUT4) + f""", {pct("count(*) FILTER (day_direction = 'long')", 'count(*)')} AS long_pct, {r('avg(max_extension)', 4)} AS avg_extension, {r('quantile_cont(ib_size, 0.5)', 4)} AS median_size FROM ibf GROUP BY day_of_week"""),
    "orb01_days": sql("SELECT * FROM orf"),
    "d16_opening_range": sql("SELECT day_of_week, count(*) AS days, " + ", ".join(pct(f"count(*) FILTER (outcome = '{o}')", "count(*)") + f" AS {o}_pct" for o in _OUT4) + f", {dist('um', 6, 'up_')} FROM (SELECT *, CASE WHEN orb_size > 0 THEN {r('up_extension / orb_size', 4)} END AS um FROM orf) GROUP BY day_of_week"),
    "ext01_days": sql(f"SELECT symbol, CAST(day AS VARCHAR) AS day, f AS day_open, day_high, day_low, {r('ul')} AS up_leg, {r('dl')} AS down_leg, direction, hod AS hod_session, lod AS lod_session, dayname(day) AS day_of_week FROM dsum"),
    "ext02_breakouts": sql("SELECT * FROM brf"),
    "d19_extension_grid": sql("SELECT session, count(*) AS days, " + ", ".join(pct(f"count(*) FILTER (cell = '{o}')", "count(*)") + f" AS {o}_pct" for o in _OUT4) + f", count(*) FILTER (sequence = 'h_then_l') AS h_then_l, count(*) FILTER (sequence = 'l_then_h') AS l_then_h, {r('avg(overshoot)', 4)} AS avg_overshoot, {r('quantile_cont(overshoot_multiple, 0.5)', 4)} AS median_multiple FROM brf GROUP BY session"),
    "d21_day_direction": sql(f"""SELECT symbol, count(*) AS days, {pct("count(*) FILTER (direction = 'long')", 'count(*)')} AS long_pct, {r(f'avg({r("ul")})', 4)} AS avg_up, {r(f'avg({r("dl")})', 4)} AS avg_down FROM dsum GROUP BY symbol"""),
    "d22_hod_lod": sql(f"""WITH n AS (SELECT count(*) AS days FROM dsum), x AS (SELECT hod AS session, 1 AS h, 0 AS l FROM dsum UNION ALL SELECT lod, 0, 1 FROM dsum)
        SELECT session, sum(h)::BIGINT AS hod, sum(l)::BIGINT AS lod, {pct('sum(h)', 'any_value(days)')} AS hod_pct, {pct('sum(l)', 'any_value(days)')} AS lod_pct FROM x, n GROUP BY session"""),
    "pk01_days": sql("SELECT * REPLACE (CAST(day AS VARCHAR) AS day), dayname(day) AS day_of_week FROM pk"),
    "d24_peak_matrix": sql("SELECT hod_session, lod_session, count(*) AS n, count(*) FILTER (net_direction = 'bullish') AS bullish FROM pk GROUP BY GROUPING SETS ((hod_session, lod_session), (hod_session), (lod_session), ())"),
    "d25_timing": sql("SELECT session, direction, count(*) AS n, quantile_cont(hour(hat), 0.25) AS p25_hour, quantile_cont(hour(hat), 0.5) AS median_hour, quantile_cont(hour(hat), 0.75) AS p75_hour FROM sr JOIN dsum USING (symbol, day) GROUP BY ALL"),
    "d32_average_time": sql("""WITH c AS (SELECT symbol, bar_ts::DATE AS day, max(high) AS h FROM b15 GROUP BY ALL), p AS (SELECT symbol, day, lag(h) OVER (PARTITION BY symbol ORDER BY day) AS pdh FROM c),
        t AS (SELECT p.symbol, p.day, min(bar_ts) FILTER (high >= pdh) AS t0 FROM p JOIN b15 b ON b.symbol = p.symbol AND b.bar_ts::DATE = p.day WHERE pdh IS NOT NULL GROUP BY ALL),
        m AS (SELECT symbol, count(*) AS n, floor(avg(hour(t0) * 60 + minute(t0)) + 0.5)::BIGINT AS a FROM t WHERE t0 IS NOT NULL GROUP BY symbol)
        SELECT symbol, n, lpad(CAST(a // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a % 60 AS VARCHAR), 2, '0') AS avg_time FROM m"""),
    "dt01_days": sql(f"""SELECT symbol, CAST(day AS VARCHAR) AS day, archetype, dayname(day) AS day_of_week, {r('size')} AS day_range, {r('size / d_low * 100', 3)} AS day_range_pct, hod AS hod_session, lod AS lod_session, axh AS swept_asia_high, axl AS swept_asia_low,
        lxh AS swept_london_high, lxl AS swept_london_low, cont AS ny_continuation, net AS net_direction, {r('x', 3)} AS expansion_factor, regime FROM dtf"""),
    "d18_day_types": sql(f"""WITH a(archetype, regime) AS (VALUES ('asia_breakout_continuation', 'trend'), ('london_breakout_continuation', 'trend'), ('ny_breakout_continuation', 'trend'), ('asia_high_london_reversal', 'london_reverse'), ('asia_low_london_reversal', 'london_reverse'),
        ('power_of_3_long', 'high_volatile'), ('power_of_3_short', 'high_volatile'), ('double_sweep_expansion', 'high_volatile'), ('inside_day', 'rare'), ('outside_day', 'rare'), ('consolidation_drift', 'rare')),
        k AS (SELECT archetype, dayname(day) AS w, count(*) AS k, min(day) AS f FROM dtf GROUP BY ALL), t AS (SELECT archetype, arg_min(w, row(-k, f)) AS top_weekday, sum(k)::BIGINT AS n FROM k GROUP BY archetype)
        SELECT a.archetype, a.regime, coalesce(n, 0) AS n, {pct('coalesce(n, 0)', '(SELECT count(*) FROM dtf)')} AS pct, top_weekday FROM a LEFT JOIN t USING (archetype)"""),
}
