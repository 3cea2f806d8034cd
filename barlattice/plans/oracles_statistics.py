"""SQL for the endpoints' statistics."""

from __future__ import annotations

from .oracles import _OUT4, _RANGES, ORACLES, VIEWS, dist, pct, r, sql
from .oracles_trading import _TOUCH

_N = "count(*)"


def n_if(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


def millionths(x: str) -> str:
    return f"avg(floor(({x}) * 1e6 + 0.5))"


def mean(x: str, places: int) -> str:
    return f"coalesce(floor({millionths(x)} / 1e{6 - places} + 0.5) / 1e{places}, 0)"


def at(time: str) -> str:
    """Mean of HH:MM strings."""
    m = f"CAST(floor(avg(CAST({time}[1:2] AS INT) * 60 + CAST({time}[4:5] AS INT)) + 0.5) AS BIGINT)"
    return f"lpad(CAST({m} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} % 60 AS VARCHAR), 2, '0')"


def shares(column: str, names, n: str = _N) -> str:
    return ", ".join(f"{pct(n_if(f'{column} = {chr(39)}{o}{chr(39)}'), n)} AS {o}_pct" for o in names)


def dists(source: str, metrics: dict[str, tuple[str, int]], by: str = "symbol") -> str:
    return " UNION ALL ".join(f"SELECT {by}, '{name}' AS metric, {dist(x, places).replace(r(f'avg({x})', places), r(f'{millionths(x)} / 1e6', places))} FROM {source} GROUP BY {by} HAVING count({x}) > 0" for name, (x, places) in metrics.items())


def label(n: str, steps=((10, "insufficient"), (30, "low"), (100, "normal")), last: str = "high") -> str:
    return "CASE " + " ".join(f"WHEN {n} < {k} THEN '{w}'" for k, w in steps) + f" ELSE '{last}' END"


_UPPER = ((5, "INSUFFICIENT"), (20, "LOW"), (50, "MEDIUM"))
_BREAKS = f"""SELECT symbol, {_N} AS n, {label(_N)} AS confidence, {shares('outcome', _OUT4)}, {pct(n_if("outcome <> 'neither'"), _N)} AS breakout_rate, {pct(n_if("outcome = 'neither'"), _N)} AS hold_rate,
    {pct(n_if("first_break_side = 'high'"), _N)} AS first_break_high_pct, {pct(n_if("first_break_side = 'low'"), _N)} AS first_break_low_pct, {pct(n_if('first_break_side IS NULL'), _N)} AS first_break_none_pct, {at('first_break_time')} AS avg_first_break_time FROM {{}} GROUP BY symbol"""
_SEEN = "(SELECT s.symbol, s.session, strftime(hat, '%H:%M') AS ht, strftime(lat, '%H:%M') AS lt, d.direction, d.hod, d.lod, dayname(d.day) AS w FROM sr s JOIN dsum d ON d.symbol = s.symbol AND d.day = s.day)"
_DAYS = "(SELECT *, 'all' AS days FROM pk UNION ALL SELECT *, net_direction || '_day' FROM pk)"
_THREE = "(VALUES ('asia'), ('london'), ('new_york'))"
_MATRIX = f"""WITH x AS (SELECT * FROM {_DAYS}), t AS (SELECT symbol, days, count(*) AS sample_size FROM x GROUP BY ALL), g AS (SELECT t.*, a.col0 AS hod_session, b.col0 AS lod_session FROM t, {_THREE} a, {_THREE} b),
    m AS (SELECT g.symbol, g.days, g.hod_session, g.lod_session, count(x.symbol) AS n, any_value(g.sample_size) AS sample_size FROM g LEFT JOIN x ON x.symbol = g.symbol AND x.days = g.days AND x.hod_session = g.hod_session AND x.lod_session = g.lod_session GROUP BY ALL)"""
_QUARTER = "lpad(CAST(CAST(floor(quantile_cont(CAST({}[1:2] AS INT), {}) + 0.5) AS BIGINT) AS VARCHAR), 2, '0')"


def window(c: str) -> str:
    return f"{_QUARTER.format(c, 0.25)} || ':00-' || {_QUARTER.format(c, 0.75)} || ':59'"


def peak(c: str) -> str:
    return f"CAST(floor(quantile_cont(CAST({c}[1:2] AS INT), 0.5) + 0.5) AS BIGINT)"


def forecast(as_of: str, current: str, target: str, before: str | None) -> str:
    prior = f"'{before}'" if before else "NULL::VARCHAR"
    views = f"""hb AS (SELECT * FROM b60 WHERE bar_ts <= TIMESTAMP '{as_of}'), fb AS (SELECT *, bar_ts::DATE AS day, CASE WHEN hour(bar_ts) < 8 THEN 'asia' WHEN hour(bar_ts) < 13 THEN 'london' ELSE 'new_york' END AS session FROM hb WHERE hour(bar_ts) < 21),
    fr AS (SELECT symbol, day, session, max(high) AS high, min(low) AS low, arg_min(open, bar_ts) AS open, arg_max(close, bar_ts) AS close FROM fb GROUP BY ALL), fz AS (SELECT *, {r('(high - low) / low * 100', 3)} AS z, close > open AS bull FROM fr),
    fw AS (SELECT c.symbol, c.day, p.high AS ph, p.low AS pl, min(bar_ts) FILTER (c.high > p.high) AS up, min(bar_ts) FILTER (c.low < p.low) AS dn, arg_min(c.close, bar_ts) FILTER (c.high > p.high) AS uc, arg_min(c.close, bar_ts) FILTER (c.low < p.low) AS dc
      FROM fb c JOIN fr p ON p.symbol = c.symbol AND p.day = c.day AND p.session = {prior} WHERE c.session = '{target}' GROUP BY ALL),
    fs AS (SELECT symbol, count(*) AS k, {n_if('up IS NOT NULL AND dn IS NULL')} AS sh, {n_if('dn IS NOT NULL AND up IS NULL')} AS sl, {n_if('up IS NOT NULL AND dn IS NOT NULL')} AS sb, {n_if('coalesce(uc < ph, false) OR coalesce(dc > pl, false)')} AS rv FROM fw WHERE up IS NOT NULL OR dn IS NOT NULL GROUP BY symbol),
    fc AS (SELECT l.symbol, count(*) AS k, {n_if('l.bull = n.bull')} AS c FROM fz l JOIN fz n ON n.symbol = l.symbol AND n.day = l.day WHERE l.session = 'london' AND n.session = 'new_york' AND '{target}' = 'new_york' GROUP BY l.symbol),
    fa AS (SELECT symbol, arg_max(close, bar_ts) AS price FROM hb GROUP BY symbol),
    fo AS (SELECT symbol, count(*) FILTER (session = '{target}' AND z > 0) AS rn, {', '.join(f"coalesce({r(f'quantile_cont(z, {f}) FILTER (session = {chr(39)}{target}{chr(39)} AND z > 0)', 3)}, 0) AS {n}" for n, f in (('lo', 0.25), ('me', 0.5), ('hi', 0.75)))},
      coalesce(min(z) FILTER (session = '{target}' AND z > 0), 0) AS mi, coalesce(max(z) FILTER (session = '{target}' AND z > 0), 0) AS ma, count(*) FILTER (session = '{target}') AS dn, count(*) FILTER (session = '{target}' AND bull) AS bn,
      count(*) FILTER (session = {prior}) AS pn, arg_max(high, day) FILTER (session = {prior}) AS ph, arg_max(low, day) FILTER (session = {prior}) AS pl FROM fz GROUP BY symbol)"""
    zero = lambda x: f"coalesce({x}, 0)"
    return sql(f"""WITH {views} SELECT symbol, TIMESTAMP '{as_of}' AS as_of, '{current}' AS current_session, '{target}' AS forecast_session, {prior} AS prior_session, rn AS range_n, me AS range_median, lo AS range_low, hi AS range_high, mi AS range_min, ma AS range_max,
        dn AS direction_n, {pct('bn', 'dn')} AS bullish, {pct('dn - bn', 'dn')} AS bearish, pn AS sweep_n, {zero('fs.k')} AS sweep_count, {pct(zero('fs.k'), 'pn')} AS sweep_prob, {zero('sh')} AS swept_high, {zero('sl')} AS swept_low, {zero('sb')} AS swept_both,
        CASE WHEN pn > 0 THEN CASE WHEN {zero('sh')} > {zero('sl')} THEN 'high' WHEN {zero('sl')} > {zero('sh')} THEN 'low' ELSE 'either' END END AS likely_side, {pct(zero('rv'), zero('fs.k'))} AS reversal_rate, {zero('fc.k')} AS continuation_n, {pct(zero('c'), zero('fc.k'))} AS continuation,
        {pct(f"{zero('fc.k')} - {zero('c')}", zero('fc.k'))} AS continuation_reversal, {r('price')} AS anchor_price, {r('price + price * (me / 100.0) / 2.0')} AS projected_high, {r('price - price * (me / 100.0) / 2.0')} AS projected_low, {r('2 * (price * (me / 100.0) / 2.0)')} AS median_range_abs, ph AS prior_session_high, pl AS prior_session_low
        FROM fa JOIN fo USING (symbol) LEFT JOIN fs USING (symbol) LEFT JOIN fc USING (symbol)""")


_SIDES = "(SELECT symbol, 'pdh' AS side, touched_pdh AS t, pdh_reversal AS v, pdh_held AS h, pdh_touch_time AS m FROM pdf UNION ALL SELECT symbol, 'pdl', touched_pdl, pdl_reversal, pdl_held, pdl_touch_time FROM pdf)"
_IB = {"ib_size": ("ib_size", 6), "ib_size_pct": ("ib_size_pct", 3), "ib_up_extension": ("up_extension", 6), "ib_down_extension": ("down_extension", 6), "max_extension": ("max_extension", 6), "size_to_extension_ratio": ("size_to_extension", 3)}
_OR = {
    "orb_size": ("orb_size", 6), "orb_up_extension": ("up_extension", 6), "orb_down_extension": ("down_extension", 6),
    "orb_up_extension_x_size": ("CASE WHEN orb_size > 0 THEN up_extension / orb_size END", 3), "orb_down_extension_x_size": ("CASE WHEN orb_size > 0 THEN down_extension / orb_size END", 3),
}
_TYPES = "(VALUES ('asia_breakout_continuation', 'trend', 0), ('london_breakout_continuation', 'trend', 1), ('ny_breakout_continuation', 'trend', 2), ('asia_high_london_reversal', 'london_reverse', 3), ('asia_low_london_reversal', 'london_reverse', 4), ('power_of_3_long', 'high_volatile', 5), ('power_of_3_short', 'high_volatile', 6), ('double_sweep_expansion', 'high_volatile', 7), ('inside_day', 'rare', 8), ('outside_day', 'rare', 9), ('consolidation_drift', 'rare', 10))"
_TOTAL = "(SELECT symbol, count(*) AS days FROM dtf GROUP BY symbol)"


def top(column: str) -> str:
    return f"SELECT symbol, w, arg_min({column}, row(-k, f)) AS top_{column}, CAST(sum(k) AS BIGINT) AS count FROM (SELECT symbol, dayname(day) AS w, {column}, count(*) AS k, min(day) AS f FROM dtf GROUP BY ALL) GROUP BY ALL"


ORACLES |= {
    "k07_ranges": sql(f"""SELECT symbol, session, {_N} AS total_sessions, {mean('range', 6)} AS avg_range, {mean('range_pct', 3)} AS avg_range_pct, {pct(n_if("direction = 'bullish'"), _N)} AS bullish_pct, {pct(n_if("direction <> 'bullish'"), _N)} AS bearish_pct,
        {mean("CASE WHEN direction = 'bullish' THEN range END", 6)} AS avg_bull_range, {mean("CASE WHEN direction <> 'bullish' THEN range END", 6)} AS avg_bear_range FROM ({_RANGES}) GROUP BY ALL"""),
    "k07_weekdays": sql(f"""SELECT symbol, session, dayname(day) AS day_of_week, {_N} AS count, {mean('range', 6)} AS avg_range, {mean('range_pct', 3)} AS avg_range_pct, {pct(n_if("direction = 'bullish'"), _N)} AS bullish_pct FROM ({_RANGES}) GROUP BY ALL"""),
    "k07_sweeps": sql(f"""WITH p AS (SELECT symbol, CASE session WHEN 'asia' THEN 'london' ELSE 'new_york' END AS session, count(*) AS d FROM sr WHERE session <> 'new_york' GROUP BY ALL),
        s AS (SELECT symbol, session, count(*) AS k, {n_if("swept_side = 'high'")} AS h, {n_if("swept_side = 'low'")} AS l, {n_if("swept_side = 'both'")} AS b, {n_if('reversal')} AS v FROM swp GROUP BY ALL)
        SELECT symbol, session, d AS total_days, coalesce(k, 0) AS sweep_count, {pct('coalesce(k, 0)', 'd')} AS sweep_rate, coalesce(h, 0) AS swept_high, coalesce(l, 0) AS swept_low, coalesce(b, 0) AS swept_both, {pct('coalesce(v, 0)', 'coalesce(k, 0)')} AS reversal_rate FROM p LEFT JOIN s USING (symbol, session)"""),
    "k07_continuation": sql(f"SELECT symbol, {_N} AS total_days, {n_if('c')} AS continuation_count, {pct(n_if('c'), _N)} AS continuation_rate, {pct(n_if('NOT c'), _N)} AS reversal_rate FROM (SELECT symbol, (lc > lo) = (nc > no) AS c FROM wide WHERE lh IS NOT NULL AND nh IS NOT NULL) GROUP BY symbol"),
    "k07_power_of_three": sql(f"""WITH p AS (SELECT symbol, {_N} AS n, {n_if('dist > ar * 1.5')} AS s, {n_if('up AND NOT dn')} AS h, {n_if('dn AND NOT up')} AS l, {mean(r('ar / adr * 100', 1), 1)} AS a FROM p3 GROUP BY symbol), e AS (SELECT symbol, {n_if('ah IS NOT NULL AND lh IS NOT NULL')} AS d FROM wide GROUP BY symbol)
        SELECT symbol, n AS total_patterns, s AS success_count, {pct('s', 'n')} AS success_rate, h AS swept_high, l AS swept_low, a AS avg_asia_range_pct, d AS eligible_days, {pct('n', 'd')} AS occurrence_rate FROM p JOIN e USING (symbol)"""),
    "k13_sides": sql(f"SELECT symbol, side, {_N} AS n, {pct(n_if('t'), _N)} AS sweep_rate, {n_if('t')} AS sweep_count, {pct(n_if('v'), n_if('t'))} AS reversal_rate_when_swept, {pct(n_if('h'), n_if('t'))} AS hold_rate_when_swept, {at('m')} AS avg_touch_time FROM {_SIDES} GROUP BY ALL"),
    "k13_outcomes": sql(f"SELECT symbol, {_N} AS n, {shares('outcome', ('pdh_only', 'pdl_only', 'both', 'neither'))} FROM pdf GROUP BY symbol"),
    "k13_weekdays": sql(f"SELECT symbol, day_of_week, {_N} AS count, {pct(n_if('touched_pdh'), _N)} AS pdh_pct, {pct(n_if('touched_pdl'), _N)} AS pdl_pct, {shares('outcome', ('both', 'neither'))} FROM pdf GROUP BY ALL"),
    "d15_breakouts": sql(_BREAKS.format("ibf")),
    "d15_extension": sql(dists("ibf", _IB)),
    "d15_weekdays": sql(f"SELECT symbol, day_of_week, {_N} AS count, {mean('ib_size_pct', 3)} AS avg_ib_size_pct, {shares('outcome', ('neither', 'both'))} FROM ibf GROUP BY ALL"),
    "d16_breakouts": sql(_BREAKS.format("orf")),
    "d16_extension": sql(dists("orf", _OR)),
    "d16_weekdays": sql(f"SELECT symbol, day_of_week, {_N} AS count, {mean('orb_size', 6)} AS avg_orb_size, {shares('outcome', ('neither', 'both'))} FROM orf GROUP BY ALL"),
    "d18_regimes": sql(f"WITH g AS (SELECT symbol, days, col0 AS regime FROM {_TOTAL}, (VALUES ('trend'), ('london_reverse'), ('high_volatile'), ('rare'))) SELECT g.symbol, g.regime, count(d.symbol) AS count, {pct('count(d.symbol)', 'any_value(days)')} AS pct FROM g LEFT JOIN dtf d ON d.symbol = g.symbol AND d.regime = g.regime GROUP BY ALL"),
    "f05_archetypes": sql(f"""WITH g AS (SELECT symbol, days, col0 AS archetype, col1 AS regime, col2 AS o FROM {_TOTAL}, {_TYPES}), x AS (SELECT g.symbol, g.archetype, g.regime, g.o, count(d.symbol) AS count, {pct('count(d.symbol)', 'any_value(days)')} AS pct, {mean(r('d.size'), 6)} AS avg_range, {mean(r('d.size / d.d_low * 100', 3), 3)} AS avg_range_pct, CAST(max(d.day) AS VARCHAR) AS last_seen
        FROM g LEFT JOIN dtf d ON d.symbol = g.symbol AND d.archetype = g.archetype GROUP BY ALL) SELECT * EXCLUDE (o), row_number() OVER (PARTITION BY symbol ORDER BY pct DESC, o) AS rank FROM x"""),
    "d18_weekdays": sql(f"WITH a AS ({top('archetype')}), b AS ({top('regime')}) SELECT a.symbol, a.w AS day_of_week, top_archetype, top_regime, a.count FROM a JOIN b ON b.symbol = a.symbol AND b.w = a.w"),
    "d20_session_ranges": sql(dists(f"({_RANGES})", {"range": ("range", 6), "range_pct": ("range_pct", 3)}, "symbol, session")),
    "d19_grid": sql(f"""SELECT symbol, session, {_N} AS n, {pct(n_if("cell <> 'neither'"), _N)} AS extension_rate, {shares('cell', _OUT4)}, {shares('sequence', ('h_then_l', 'l_then_h'))}, {mean('overshoot', 6)} AS avg_overshoot, {mean('overshoot_multiple', 3)} AS avg_overshoot_multiple, count(overshoot) AS overshoot_sample FROM brf GROUP BY ALL"""),
    "d21_directions": sql(f"""SELECT symbol, {_N} AS n, {pct(n_if("direction = 'long'"), _N)} AS long_day_pct, {pct(n_if("direction = 'short'"), _N)} AS short_day_pct, {mean(r('ul'), 6)} AS avg_up_leg, {mean(r('dl'), 6)} AS avg_down_leg FROM dsum GROUP BY symbol"""),
    "d22_extremes": sql(f"SELECT symbol, session, {_N} AS n, {pct(n_if('hod = session'), _N)} AS hod_pct, {pct(n_if('lod = session'), _N)} AS lod_pct, {pct(n_if('hod = session AND lod = session'), _N)} AS both_pct, {pct(n_if('hod <> session AND lod <> session'), _N)} AS neither_pct, {label(_N, _UPPER, 'HIGH')} AS confidence FROM {_SEEN} GROUP BY symbol, session"),
    "d23_directions": sql(f"""SELECT symbol, session, w AS day_of_week, {_N} AS count, {pct(n_if("direction = 'long'"), _N)} AS long_pct, {pct(n_if("direction = 'short'"), _N)} AS short_pct FROM {_SEEN} GROUP BY GROUPING SETS ((symbol, session), (symbol, session, w))"""),
    "d25_windows": sql(f"SELECT symbol, session, direction, {_N} AS sample_size, {window('ht')} AS high_window, {window('lt')} AS low_window, {peak('ht')} AS high_peak_hour, {peak('lt')} AS low_peak_hour FROM {_SEEN} GROUP BY symbol, session, direction"),
    "d24_matrix": sql(_MATRIX + f" SELECT symbol, days, hod_session, lod_session, n, {pct('n', 'sample_size')} AS pct, sample_size, {label('sample_size', _UPPER, 'HIGH')} AS confidence FROM m"),
    "d24_marginals": sql(_MATRIX + f", h AS (SELECT symbol, days, sample_size, hod_session AS session, CAST(sum(n) AS BIGINT) AS hod FROM m GROUP BY ALL), l AS (SELECT symbol, days, lod_session AS session, CAST(sum(n) AS BIGINT) AS lod FROM m GROUP BY ALL) SELECT symbol, days, session, hod, {pct('hod', 'sample_size')} AS hod_pct, lod, {pct('lod', 'sample_size')} AS lod_pct, sample_size FROM h JOIN l USING (symbol, days, session)"),
    "d17_touches": sql(_TOUCH + f""" SELECT symbol, {_N} AS n, {label(_N)} AS confidence, {pct('count(a)', _N)} AS prev_poc_pct, {pct('count(b)', _N)} AS prev_vah_pct, {pct('count(e)', _N)} AS prev_val_pct, {pct(n_if('total_tpos >= 10'), _N)} AS tpo_quality_normal_pct,
        {at("strftime(a, '%H:%M')")} AS avg_prev_poc_touch_time, {at("strftime(b, '%H:%M')")} AS avg_prev_vah_touch_time, {at("strftime(e, '%H:%M')")} AS avg_prev_val_touch_time FROM t GROUP BY symbol"""),
    "d17_extension": sql(_TOUCH + f", z AS (SELECT k, {r('max(high) - min(low)')} AS x FROM rth GROUP BY k), y AS (SELECT c.symbol, x FROM c JOIN z USING (k)) " + dists("y", {"rth_extension": ("x", 6)})),
    "d17_weekdays": sql(_TOUCH + f" SELECT symbol, dayname(day) AS day_of_week, {_N} AS count, {pct('count(a)', _N)} AS prev_poc_pct, {pct('count(b)', _N)} AS prev_vah_pct, {pct('count(e)', _N)} AS prev_val_pct FROM t GROUP BY symbol, dayname(day)"),
    "fc01_forecast_london": forecast("2024-01-20 05:00:00", "asia", "london", "asia"),
    "fc01_forecast_new_york": forecast("2024-01-20 10:30:00", "london", "new_york", "london"),
    "fc01_forecast_asia": forecast("2024-01-20 22:00:00", "post_ny", "asia", None),
}
assert "dtf" in VIEWS

VIEWS["fev"] = """SELECT *, NULL::VARCHAR AS htf, NULL::BOOLEAN AS tested FROM sev UNION ALL SELECT symbol, NULL, NULL, 'smc_' || kind || '_test', session, CASE WHEN kind IN ('ob', 'fvg', 'bos', 'choch') THEN CASE bias WHEN 1 THEN 'bullish' ELSE 'bearish' END END,
    CASE kind WHEN 'eq' THEN CASE bias WHEN -1 THEN 'EQH' ELSE 'EQL' END WHEN 'sweep' THEN 'WICK' END, CASE kind WHEN 'ob' THEN held WHEN 'fvg' THEN filled ELSE success END, coalesce(max_move_pct, filled_pct),
    CASE WHEN kind IN ('ob', 'fvg', 'bos', 'choch') THEN CASE bias WHEN 1 THEN 'bullish' ELSE 'bearish' END END, CASE kind WHEN 'ob' THEN retested WHEN 'eq' THEN swept END FROM wout"""
_DOUBLE = ("swept_high", "swept_low", "swept_both", "reversal_count", "bullish", "bearish", "eqh", "eql", "wick", "retest")
_SWEEP, _W, _T, _UP = "event_type IN ('asia_sweep', 'london_sweep')", n_if("win"), n_if("tested"), n_if("direction = 'bullish'")


def when(condition: str, figure: str, name: str) -> str:
    return f"CASE WHEN {condition} THEN {figure} END{'::DOUBLE' if name in _DOUBLE else ''} AS {name}"


def smc(*kinds: str) -> str:
    return "event_type IN (" + ", ".join(f"'smc_{k}_test'" for k in kinds) + ")"


def results(source: str, where: str = "true", by: str = "event_type") -> str:
    figures = [
        when(f"{_SWEEP} OR event_type = 'power_of_3'", n_if("side = 'high'"), "swept_high"), when(f"{_SWEEP} OR event_type = 'power_of_3'", n_if("side = 'low'"), "swept_low"), when(_SWEEP, n_if("side = 'both'"), "swept_both"), when(_SWEEP, _W, "reversal_count"),
        f"CASE WHEN {_SWEEP} OR {smc('choch', 'eq')} THEN {pct(_W, _N)} WHEN event_type = 'ny_continuation' THEN {pct(f'{_N} - {_W}', _N)} END AS reversal_rate", when(f"event_type = 'ny_continuation' OR {smc('bos')}", pct(_W, _N), "continuation_rate"),
        when("event_type = 'session_range'", pct(_UP, _N), "bullish_rate"), when("event_type = 'session_range'", pct(f"{_N} - {_UP}", _N), "bearish_rate"), when("event_type = 'session_range'", mean("value", 3), "avg_range_pct"),
        when(f"event_type = 'power_of_3' OR {smc('sweep')}", pct(_W, _N), "success_rate"), when(smc("ob"), pct(_T, _N), "retest_rate"), when(smc("ob"), pct(_W, _T), "hold_rate_when_retested"), when(smc("ob"), pct(_W, _N), "hold_rate_overall"),
        when(smc("fvg"), pct(_W, _N), "fill_rate"), when(smc("fvg"), mean("value", 1), "avg_fill_pct"), when(smc("bos", "choch", "sweep"), mean("value", 4), "avg_max_move_pct"), when(smc("eq"), pct(_T, _N), "sweep_rate"), when(smc("eq"), pct(_W, _T), "reversal_rate_when_swept"),
    ]
    return sql(f"SELECT {by}, {_N} AS n, {', '.join(figures)}, {label(_N, _UPPER, 'HIGH')} AS confidence FROM {source} WHERE {where} GROUP BY {by}")


def of_kind(kinds: str, figure: str, name: str) -> str:
    return when("kind IN (" + ", ".join(f"'{k}'" for k in kinds.split()) + ")", figure, name)


_BULL, _BEAR = n_if("bias = 1"), n_if("bias = -1")
_SIX = ", ".join([
    of_kind("ob", pct(n_if("retested"), _N), "retest_rate"), of_kind("ob", pct(n_if("held"), _N), "hold_rate"), of_kind("ob", pct(n_if("held"), n_if("retested")), "hold_rate_when_retested"), of_kind("ob", mean("CASE WHEN retested THEN retested_within END", 1), "avg_retest_candles"),
    of_kind("fvg", pct(n_if("filled"), _N), "fill_rate"), of_kind("fvg", mean("CASE WHEN filled THEN filled_within END", 1), "avg_fill_candles"), of_kind("fvg", mean("filled_pct", 1), "avg_fill_pct"), of_kind("bos", pct(n_if("success"), _N), "continuation_rate"),
    of_kind("choch eq", pct(n_if("success"), _N), "reversal_rate"), of_kind("eq", pct(n_if("swept"), _N), "sweep_rate"), of_kind("eq", pct(n_if("success"), n_if("swept")), "reversal_rate_when_swept"), of_kind("eq", mean("max_move_pct", 4), "avg_reversal_pct"),
    of_kind("sweep", pct(n_if("success"), _N), "success_rate"), of_kind("bos choch sweep", mean("max_move_pct", 4), "avg_max_move_pct"), of_kind("ob fvg bos choch", _BULL, "bullish"), of_kind("ob fvg bos choch", _BEAR, "bearish"), of_kind("eq", _BEAR, "eqh"), of_kind("eq", _BULL, "eql"), of_kind("sweep", _N, "wick"), of_kind("sweep", "0", "retest"),
])
_DIM = ("session", "day_of_week", "direction", "side")
_CELLS = " UNION ALL ".join(
    "SELECT event_type, " + ", ".join(d if d in s else f"NULL::VARCHAR AS {d}" for d in _DIM) + f", count(*) AS n, {pct(_W, _N)} AS win_rate FROM ev WHERE " + " AND ".join(f"{d} IS NOT NULL" for d in s) + " GROUP BY event_type, " + ", ".join(s) + " HAVING count(*) >= 10"
    for s in [(a,) for a in _DIM] + [(a, b) for i, a in enumerate(_DIM) for b in _DIM[i + 1 :]]
)

ORACLES |= {
    "bt01_outcomes": results("fev"),
    "bt01_sweep_side": results("fev", "side = 'high' AND NOT starts_with(event_type, 'smc_')", "event_type, symbol"),
    "bt01_htf_bias": results("fev", "htf = 'bearish'"),
    "bt01_direction": results("fev", "direction = 'bullish' AND day_of_week = 'Monday'"),
    "d13_success": sql(f"SELECT event_type, day_of_week, {_N} AS count, {pct(_W, _N)} AS success_pct FROM sev GROUP BY ALL"),
    "d11_aggregates": sql(f"SELECT kind, {_N} AS n, {_SIX} FROM wout GROUP BY kind"),
    "d12_baselines": sql(f"SELECT event_type, {_N} AS n, {pct(_W, _N)} AS baseline FROM sev WHERE event_type <> 'session_range' GROUP BY event_type"),
    "f03_extremes": sql(f"""WITH ev AS (SELECT * FROM sev WHERE event_type <> 'session_range'), b AS (SELECT event_type, {pct(_W, _N)} AS baseline FROM ev GROUP BY event_type), c AS ({_CELLS}),
        e AS (SELECT c.*, baseline, {r('(win_rate - baseline) * sqrt(n::DOUBLE)', 2)} AS edge_score FROM c JOIN b USING (event_type) WHERE abs(win_rate - baseline) >= 1.0)
        SELECT *, CASE WHEN edge_score > 0 THEN 'edges' ELSE 'anti_patterns' END AS list, row_number() OVER (PARTITION BY edge_score > 0 ORDER BY abs(edge_score) DESC, event_type, coalesce(session, ''), coalesce(day_of_week, ''), coalesce(direction, ''), coalesce(side, '')) AS rank FROM e WHERE edge_score <> 0 QUALIFY rank <= 10"""),
    "f04_ranked_read": f"SELECT *, row_number() OVER (ORDER BY abs(r) DESC, other) AS rank FROM ({ORACLES['cor02_base']})",
    "cnf04_adr_ratio": sql(f"""WITH d AS (SELECT symbol, bar_ts::DATE AS day, max(high) - min(low) AS z FROM b60 GROUP BY ALL), m AS (SELECT *, max(day) OVER (PARTITION BY symbol) AS l FROM d)
        SELECT symbol, count(*) AS days, {r('max(z) FILTER (day = l)')} AS today_range, {r('avg(z) FILTER (day < l)')} AS adr, {r('max(z) FILTER (day = l) / avg(z) FILTER (day < l)')} AS ratio FROM m GROUP BY symbol HAVING count(*) >= 3"""),
    "b12_recent_equal_levels": sql(f"""WITH n AS (SELECT symbol, count(*) AS n FROM b15 GROUP BY symbol) SELECT k AS symbol, ord, type, {r('level')} AS level, prev_index, curr_index FROM m_eq JOIN n ON n.symbol = k WHERE curr_index > n * 0.7 QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord DESC) <= 10"""),
    "smc13_gate": sql("WITH x AS (SELECT * FROM b60 WHERE bar_ts < TIMESTAMP '2024-01-03') SELECT symbol, bar_ts, close FROM x WHERE symbol IN (SELECT symbol FROM x GROUP BY symbol HAVING count(*) >= 41)"),
    "b10_enough_days": sql("SELECT symbol, count(*) AS days FROM orf GROUP BY symbol HAVING count(*) >= 10"),
    "a03_complete_scan": sql("SELECT *, true AS complete FROM b60 WHERE symbol IN ('click', 'view') AND bar_ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 10:30:00'"),
    "a07_series": f"""WITH p AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, count(*) FILTER (o_orderstatus = 'F') AS l, count(*) FILTER (o_orderstatus <> 'F') AS s, count(*) AS n FROM orders GROUP BY ALL)
        SELECT ts, n::DOUBLE AS oi, {r('l / greatest(s, 1)')} AS ratio, CASE WHEN day(ts) <= 20 THEN l::DOUBLE END AS buy_vol, NULL::DOUBLE AS sell_vol FROM p""",
}
