"""SQL for profiles, flow, events, trades, edges and confluence."""

from __future__ import annotations

from .oracles import ORACLES, VIEWS, pct, r, sql
from .oracles_structure import structure_views


def profile_views(p: str, source: str) -> dict[str, str]:
    """Views over ``source(k, bar_ts, open, high, low, close)``: one profile per ``k``."""
    return {
        f"{p}s": f"""SELECT *, CASE WHEN r0 > 200 THEN (t - b) / 100 ELSE tick0 END AS tick, CASE WHEN r0 > 200 THEN 100 ELSE r0 END AS rows FROM (SELECT *, greatest(1, CAST(floor((t - b) / tick0 + 0.5) AS BIGINT)) AS r0 FROM (
            SELECT *, floor(lo / tick0) * tick0 AS b, ceil(hi / tick0) * tick0 AS t FROM (SELECT k, hi, lo, n, s, e, CASE WHEN m IS NULL THEN 1.0 ELSE pow(10.0, floor(log10(m / 10))) * CASE WHEN m / 10 / pow(10.0, floor(log10(m / 10))) <= 1.5 THEN 1 WHEN m / 10 / pow(10.0, floor(log10(m / 10))) <= 3.5 THEN 2
            WHEN m / 10 / pow(10.0, floor(log10(m / 10))) <= 7.5 THEN 5 ELSE 10 END END AS tick0 FROM (SELECT k, max(high) AS hi, min(low) AS lo, count(*) AS n, min(bar_ts) AS s, max(bar_ts) AS e, (list_sort(list(high - low) FILTER (high > low)))[count(*) FILTER (high > low) // 2 + 1] AS m FROM {source} GROUP BY k) WHERE hi > lo)))""",
        f"{p}g": f"SELECT *, floor((b + j * tick) * 1e10 + 0.5) / 1e10 AS price FROM (SELECT *, unnest(range(0, rows)) AS j FROM {p}s)",
        f"{p}b": f"SELECT *, row_number() OVER (PARTITION BY k ORDER BY bar_ts) - 1 AS c FROM {source}",
        f"{p}r": f"""SELECT g.k, g.j, g.price, g.tick, g.hi, g.lo, g.s, g.e, count(x.c) AS cnt, coalesce(string_agg(CASE WHEN x.c < 52 THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', CAST(x.c + 1 AS BIGINT), 1) ELSE CAST(x.c AS VARCHAR) END, '' ORDER BY x.c), '') AS letters
            FROM {p}g g LEFT JOIN {p}b x ON x.k = g.k AND x.low < g.price + g.tick AND x.high >= g.price GROUP BY ALL""",
        f"{p}p": f"""SELECT k, any_value(s) AS s, any_value(e) AS e, any_value(tick) AS tick, arg_min(j, row(-cnt, abs(price + tick / 2 - (hi + lo) / 2), j)) AS poc, max(cnt) AS pc, sum(cnt)::BIGINT AS total, list(cnt ORDER BY j) AS cs, list(price ORDER BY j) AS ps FROM {p}r GROUP BY k""",
    }


def value_area(p: str) -> str:
    """A recursive part ``va(k, val, vah, rest, step)`` and a view ``fin`` of last steps."""
    c = lambda i: f"coalesce(CASE WHEN {i} BETWEEN 0 AND len(cs) - 1 THEN cs[({i}) + 1] END, 0)"
    u1, u2, d1, d2 = c("vah + 1"), c("vah + 2"), c("val - 1"), c("val - 2")
    top, bottom = "vah >= len(cs) - 1", "val <= 0"
    up = f"abs(vah - len(cs) // 2) <= abs(val - len(cs) // 2)"
    nu = f"CASE WHEN {top} THEN 0 WHEN {bottom} THEN CASE WHEN {u1} > 0 THEN 1 ELSE 0 END WHEN {u1} + {u2} > {d1} + {d2} THEN CASE WHEN vah + 2 <= len(cs) - 1 THEN 2 ELSE 1 END WHEN {u1} + {u2} < {d1} + {d2} THEN 0 WHEN {up} THEN 1 ELSE 0 END"
    nd = f"CASE WHEN {bottom} THEN 0 WHEN {top} THEN CASE WHEN {d1} > 0 THEN 1 ELSE 0 END WHEN {d1} + {d2} > {u1} + {u2} THEN CASE WHEN val - 2 >= 0 THEN 2 ELSE 1 END WHEN {d1} + {d2} < {u1} + {u2} THEN 0 WHEN {up} THEN 0 ELSE 1 END"
    cost = f"CASE WHEN nu = 2 THEN {u1} + {u2} WHEN nu = 1 THEN {u1} ELSE 0 END + CASE WHEN nd = 2 THEN {d1} + {d2} WHEN nd = 1 THEN {d1} ELSE 0 END"
    return f"""WITH RECURSIVE va AS (SELECT k, cs, poc AS val, poc AS vah, CAST(floor(total * 0.6826) AS BIGINT) - cs[poc + 1] AS rest, 0 AS step FROM {p}p
        UNION ALL SELECT k, cs, val - nd, vah + nu, rest - ({cost}), step + 1 FROM (SELECT *, {nu} AS nu, {nd} AS nd FROM va WHERE rest > 0 AND NOT ({top} AND {bottom})) WHERE nu + nd > 0),
        fin AS (SELECT k, arg_max(val, step) AS val, arg_max(vah, step) AS vah FROM va GROUP BY k),
        prof AS (SELECT q.k, s AS start_ts, e AS end_ts, tick, ps[poc + 1] + tick / 2 AS poc, ps[vah + 1] + tick AS vah, ps[val + 1] AS val, pc AS poc_count, total AS total_tpos, poc AS poc_j, val AS val_j, vah AS vah_j FROM {p}p q JOIN fin USING (k))"""


_KEY = "symbol || '|' || strftime({}, '%Y-%m-%d %H:%M:%S')"
_UNKEY = "split_part(k, '|', 1) AS symbol, CAST(split_part(k, '|', 2) AS TIMESTAMP) AS sess"
VIEWS["s15"] = f"SELECT {_KEY.format('d')} AS k, bar_ts, open, high, low, close FROM (SELECT *, date_trunc('day', bar_ts)::TIMESTAMP AS d FROM b15 QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY d DESC) <= 10)"
VIEWS["s5"] = f"SELECT {_KEY.format('d')} AS k, bar_ts, open, high, low, close FROM (SELECT *, time_bucket(INTERVAL '4 hours', bar_ts) AS d FROM b5 QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY d DESC) <= 10)"
VIEWS["rth"] = f"""SELECT {_KEY.format('d')} AS k, bar_ts, open, high, low, close FROM (SELECT *, bar_ts::DATE::TIMESTAMP AS d, hour(bar_ts) * 60 + minute(bar_ts) AS m FROM b15 SEMI JOIN (SELECT symbol, day FROM cd) z ON z.symbol = b15.symbol AND z.day = b15.bar_ts::DATE) WHERE m >= 810 AND m < 1200 QUALIFY count(*) OVER (PARTITION BY symbol, d) >= 2"""
VIEWS["h1"] = "SELECT symbol AS k, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS i, bar_ts, open, high, low, close FROM (SELECT * FROM b60 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) <= 300)"
VIEWS["h4"] = "SELECT symbol AS k, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS i, bar_ts, open, high, low, close FROM (SELECT * FROM b240 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) <= 300)"
VIEWS["hlast"] = "SELECT k, bar_ts, open, high, low, close FROM h1 QUALIFY bar_ts::DATE = max(bar_ts::DATE) OVER (PARTITION BY k)"
for _p, _s in (("q_", "s15"), ("f_", "s5"), ("e_", "rth"), ("l_", "hlast")):
    VIEWS |= profile_views(_p, _s)
VIEWS |= structure_views("c_", "h1", 20, 5)
VIEWS |= {k: v for k, v in structure_views("d_", "h4", 20, 5).items() if k in ("d_pi", "d_xi", "d_bi", "d_tr")}
VIEWS["sev"] = f"""SELECT symbol, day, dayname(day) AS day_of_week, 'session_range' AS event_type, session, CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END AS direction, NULL AS side, close > open AS win, {r('(high - low) / low * 100', 3)} AS value FROM sr
    UNION ALL SELECT symbol, day, dayname(day), CASE session WHEN 'london' THEN 'asia_sweep' ELSE 'london_sweep' END, session, NULL, swept_side, reversal, {r('dist')} FROM swp
    UNION ALL SELECT symbol, day, dayname(day), 'ny_continuation', NULL, CASE WHEN nc > no THEN 'bullish' ELSE 'bearish' END, NULL, (lc > lo) = (nc > no), {r('nh - nl')} FROM wide WHERE lh IS NOT NULL AND nh IS NOT NULL
    UNION ALL SELECT symbol, day, dayname(day), 'power_of_3', NULL, CASE WHEN bull THEN 'bullish' ELSE 'bearish' END, CASE WHEN up AND dn THEN 'both' WHEN up THEN 'high' ELSE 'low' END, dist > ar * 1.5, {r('dist')} FROM p3"""
VIEWS["aev"] = """SELECT * FROM sev UNION ALL SELECT symbol, NULL, NULL, 'smc_' || kind || '_test', session, CASE WHEN kind IN ('ob', 'fvg', 'bos', 'choch') THEN CASE bias WHEN 1 THEN 'bullish' ELSE 'bearish' END END,
    CASE kind WHEN 'eq' THEN CASE bias WHEN -1 THEN 'EQH' ELSE 'EQL' END WHEN 'sweep' THEN 'WICK' END, CASE kind WHEN 'ob' THEN held WHEN 'fvg' THEN filled ELSE success END, coalesce(max_move_pct, filled_pct) FROM wout"""
VIEWS["ent"] = f"""SELECT s.symbol, s.day, s.session AS conf, b.i, b.close AS entry, (SELECT {r('avg(CASE WHEN z.i = greatest(b.i - 13, 0) THEN z.high - z.low ELSE z.tr END)')} FROM tr z WHERE z.symbol = b.symbol AND z.i BETWEEN b.i - 13 AND b.i) AS atr
    FROM (SELECT symbol, day, session, max(bar_ts) AS t FROM sb GROUP BY ALL) s JOIN b60i b ON b.symbol = s.symbol AND b.bar_ts = s.t"""
VIEWS["trd"] = """SELECT e.symbol, e.day, e.event_type, e.session, t.i, t.entry, t.atr, CASE WHEN e.event_type IN ('asia_sweep', 'london_sweep') THEN CASE e.side WHEN 'high' THEN CASE WHEN e.win THEN 'short' ELSE 'long' END WHEN 'low' THEN CASE WHEN e.win THEN 'long' ELSE 'short' END END WHEN e.direction = 'bullish' THEN 'long' ELSE 'short' END AS ts
    FROM sev e LEFT JOIN ent t ON t.symbol = e.symbol AND t.day = e.day AND t.conf = CASE e.event_type WHEN 'session_range' THEN e.session WHEN 'asia_sweep' THEN 'london' ELSE 'new_york' END"""
VIEWS["trf"] = """SELECT *, CASE WHEN ts = 'long' THEN entry - atr ELSE entry + atr END AS stop, CASE WHEN ts = 'long' THEN entry + atr * 2 ELSE entry - atr * 2 END AS goal FROM trd"""
VIEWS["trh"] = """SELECT t.symbol, t.day, t.event_type, t.session, min(b.i) AS any_i, max(b.i) AS last_i, arg_max(b.close, b.i) AS last_close, min(b.i) FILTER (CASE WHEN ts = 'long' THEN b.low <= stop ELSE b.high >= stop END) AS s_i, min(b.i) FILTER (CASE WHEN ts = 'long' THEN b.high >= goal ELSE b.low <= goal END) AS g_i
    FROM trf t JOIN b60i b ON b.symbol = t.symbol AND b.i > t.i AND b.i <= t.i + 48 GROUP BY t.symbol, t.day, t.event_type, t.session"""
VIEWS["sim"] = f"""SELECT t.symbol, t.day, t.event_type, t.session, t.ts AS trade_side, t.i AS bar_idx, t.entry, CASE WHEN skip IS NULL THEN {r('stop')} END AS stop, CASE WHEN skip IS NULL THEN {r('goal')} END AS target,
    CASE WHEN skip IS NULL THEN CASE WHEN s_i = g_i THEN 'stop_ambiguous' WHEN s_i IS NOT NULL AND (g_i IS NULL OR s_i < g_i) THEN 'stop' WHEN g_i IS NOT NULL THEN 'target' ELSE 'time' END END AS exit_reason,
    CASE WHEN skip IS NULL THEN coalesce(least(s_i, g_i), last_i) - t.i END AS bars_held,
    CASE WHEN skip IS NULL THEN {r("CASE WHEN s_i IS NOT NULL AND (g_i IS NULL OR s_i <= g_i) THEN -1.0 WHEN g_i IS NOT NULL THEN 2.0 ELSE CASE WHEN ts = 'long' THEN 1.0 ELSE -1.0 END * (last_close - t.entry) / t.atr END")} END AS r, skip
    FROM (SELECT f.*, any_i, last_i, last_close, s_i, g_i, CASE WHEN f.entry IS NULL THEN 'no_entry_candle' WHEN ts IS NULL THEN 'no_direction' WHEN NOT (atr > 0) THEN 'zero_atr' WHEN any_i IS NULL THEN 'no_forward_bars' END AS skip
      FROM trf f LEFT JOIN trh h ON h.symbol = f.symbol AND h.day = f.day AND h.event_type = f.event_type AND h.session IS NOT DISTINCT FROM f.session) t"""
VIEWS["eth"] = "SELECT 1"

_WIN = "count(*) FILTER (win)"


def _freq(by: str, source: str, where: str = "") -> str:
    keys = f"event_type{by}"
    return f"""SELECT {keys}, count(*) AS n, {_WIN} AS wins, {pct(_WIN, 'count(*)')} AS win_pct, count(*) FILTER (side = 'high') AS swept_high, count(*) FILTER (side = 'low') AS swept_low, count(*) FILTER (side = 'both') AS swept_both, {r('avg(value)', 9)} AS avg_value,
        CASE WHEN count(*) >= 50 THEN 'HIGH' WHEN count(*) >= 20 THEN 'MEDIUM' WHEN count(*) >= 5 THEN 'LOW' ELSE 'INSUFFICIENT' END AS confidence FROM {source} {where} GROUP BY {keys}"""


_LV = "b.i"
_FLOW = """WITH t AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS bar_ts FROM ticks {where}), f AS (SELECT symbol, bar_ts, arg_min(price, ts) AS p FROM t GROUP BY ALL), k AS (SELECT *, CASE WHEN p > 10000 THEN 50.0 WHEN p > 1000 THEN 10.0 WHEN p > 100 THEN 1.0 WHEN p > 10 THEN 0.5 WHEN p > 1 THEN 0.1 ELSE 0.01 END::DOUBLE AS tick FROM f),
    lv AS (SELECT symbol, bar_ts, floor(price / tick) * tick AS level, coalesce(sum(qty) FILTER (NOT is_buyer_maker), 0.0) AS buy_vol, coalesce(sum(qty) FILTER (is_buyer_maker), 0.0) AS sell_vol, count(*) FILTER (NOT is_buyer_maker) AS buy_count, count(*) FILTER (is_buyer_maker) AS sell_count FROM t JOIN k USING (symbol, bar_ts) GROUP BY ALL)"""
_DELTA = "SELECT symbol, bar_ts, buy, sell, buy - sell AS delta, sum(buy - sell) OVER (PARTITION BY symbol ORDER BY bar_ts) AS cvd{more} FROM (SELECT symbol, bar_ts, sum(buy_vol) AS buy, sum(sell_vol) AS sell FROM lv GROUP BY ALL)"


def _confluence(near: float) -> str:
    off = lambda x: f"abs(price - ({x})) / price * 100"
    return value_area("l_") + f""", px AS (SELECT k, arg_max(close, i) AS price, max(bar_ts) AS as_of, count(*) AS n, max(high) FILTER (i >= mx - 49) AS h50, min(low) FILTER (i >= mx - 49) AS l50 FROM (SELECT *, max(i) OVER (PARTITION BY k) AS mx FROM h1) GROUP BY k),
        sw AS (SELECT k, arg_max(price, i) FILTER (side = 'high') AS sh, arg_max(price, i) FILTER (side = 'low') AS sl FROM c_ps GROUP BY k),
        b AS (SELECT px.*, coalesce(a.trend_bias, 0) AS t1, coalesce(c.trend_bias, 0) AS t4, CASE WHEN sh IS NOT NULL AND sl IS NOT NULL THEN CASE WHEN price > sh THEN h50 ELSE sh END END AS sh, CASE WHEN sh IS NOT NULL AND sl IS NOT NULL THEN CASE WHEN price < sl THEN l50 ELSE sl END END AS sl
          FROM px LEFT JOIN c_tr a ON a.k = px.k LEFT JOIN d_tr c ON c.k = px.k LEFT JOIN sw ON sw.k = px.k),
        z AS (SELECT *, CASE WHEN t4 <> 0 THEN t4 WHEN t1 = 1 THEN 1 ELSE -1 END AS dir, t4 <> 0 AND CASE WHEN t1 = 1 THEN 1 ELSE -1 END <> t4 AS counter FROM b),
        ob AS (SELECT z.k, arg_min(ob_high, ord) AS oh, arg_min(ob_low, ord) AS ol FROM z JOIN c_ob o ON o.k = z.k AND o.bias = z.dir WHERE {off('(ob_high + ob_low) / 2')} < {near} GROUP BY z.k),
        fg AS (SELECT DISTINCT z.k FROM z JOIN c_fg g ON g.k = z.k AND g.bias = z.dir WHERE {off('(top + bottom) / 2')} < {near}),
        sp AS (SELECT z.k, arg_max(bar_index, row(bar_index, pivot_index)) AS si FROM z JOIN c_lq q ON q.k = z.k AND q.bias = z.dir WHERE bar_index >= n - 30 GROUP BY z.k),
        ms AS (SELECT z.k, arg_min(type, ord) AS after_sweep FROM z JOIN sp ON sp.k = z.k JOIN c_st s ON s.k = z.k AND s.bias = z.dir AND s.end_index > si GROUP BY z.k),
        pool AS (SELECT k, level FROM c_eq UNION ALL SELECT k, sh FROM z WHERE sh IS NOT NULL UNION ALL SELECT k, sl FROM z WHERE sl IS NOT NULL),
        dl AS (SELECT z.k, min((level - price) * dir) AS far FROM z JOIN pool ON pool.k = z.k WHERE (level - price) * dir > 0 AND NOT EXISTS (SELECT 1 FROM c_lq q WHERE q.k = z.k AND floor(q.level * 100 + 0.5) = floor(pool.level * 100 + 0.5)) GROUP BY z.k),
        goal AS (SELECT z.k, CASE dir WHEN 1 THEN ob_low ELSE ob_high END AS x, price, dir, true AS own FROM z JOIN c_ob o ON o.k = z.k AND o.bias = -z.dir UNION ALL SELECT z.k, CASE dir WHEN 1 THEN bottom ELSE top END, price, dir, false FROM z JOIN c_fg g ON g.k = z.k WHERE ((top + bottom) / 2 - price) * dir > 0
          UNION ALL SELECT k, CASE dir WHEN 1 THEN sh ELSE sl END, price, dir, true FROM z UNION ALL SELECT z.k, level, price, dir, true FROM z JOIN c_eq q ON q.k = z.k),
        tg AS (SELECT k, CASE any_value(dir) WHEN 1 THEN min(x) ELSE max(x) END AS g FROM goal WHERE (NOT own OR (x - price) * dir > 0) AND abs(x - price) > 0 AND abs(x - price) <= price * 2.0 / 100 GROUP BY k),
        at14 AS (SELECT k, {r('avg(tr)')} AS atr FROM (SELECT k, i, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, max(i) OVER (PARTITION BY k) AS mx FROM (SELECT *, lag(close) OVER (PARTITION BY k ORDER BY i) AS pc FROM h1)) WHERE i >= mx - 13 GROUP BY k),
        fa AS (SELECT z.*, ob.oh, ob.ol, ob.k IS NOT NULL AS has_ob, fg.k IS NOT NULL AS has_fg, sp.k IS NOT NULL AS has_sp, after_sweep, g, atr, coalesce(far / price * 100 < 5, false) AS has_dl,
          coalesce(CASE dir WHEN 1 THEN (oh + ol) / 2 BETWEEN sh - 0.786 * (sh - sl) AND sh - 0.618 * (sh - sl) ELSE (oh + ol) / 2 BETWEEN sl + 0.618 * (sh - sl) AND sl + 0.786 * (sh - sl) END AND sh > sl, false) AS ote,
          coalesce(sh > sl AND CASE dir WHEN 1 THEN (price - sl) / (sh - sl) * 100 < 20 ELSE (price - sl) / (sh - sl) * 100 > 80 END, false) AS deep,
          n >= 20 AND (coalesce(abs((oh + ol) / 2 - poc) <= greatest(oh - ol, price * 0.003), false) OR coalesce(abs((oh + ol) / 2 - vah) <= greatest(oh - ol, price * 0.003), false) OR coalesce(abs((oh + ol) / 2 - val) <= greatest(oh - ol, price * 0.003), false)) AS tpo
          FROM z LEFT JOIN ob ON ob.k = z.k LEFT JOIN fg ON fg.k = z.k LEFT JOIN sp ON sp.k = z.k LEFT JOIN ms ON ms.k = z.k LEFT JOIN dl ON dl.k = z.k LEFT JOIN tg ON tg.k = z.k LEFT JOIN at14 ON at14.k = z.k LEFT JOIN prof ON prof.k = z.k),
        sc AS (SELECT *, CASE WHEN has_ob THEN (t4 <> 0)::INT + 2 + has_fg::INT + ote::INT + 2 * has_sp::INT + has_dl::INT + deep::INT + 1 + 2 * tpo::INT ELSE 0 END AS score FROM fa)
        SELECT k AS symbol, as_of, price, score, CASE dir WHEN 1 THEN 'long' ELSE 'short' END AS direction, counter AS is_counter_trend, score >= 6 AND NOT (counter AND score < 8) AS meets_threshold,
        CASE WHEN has_ob THEN concat_ws(',', CASE WHEN t4 <> 0 THEN '4H bias' END, 'OB', CASE WHEN has_fg THEN 'FVG' END, CASE WHEN ote THEN 'OTE' END, CASE WHEN has_sp THEN 'sweep' END, CASE WHEN has_dl THEN 'draw' END, CASE WHEN deep THEN 'deep zone' END, 'no macro', CASE WHEN tpo THEN 'TPO' END) ELSE '' END AS factors,
        CASE WHEN has_ob THEN after_sweep END AS after_sweep, {r('coalesce(g, price * (1 + dir * 2.0 / 100))')} AS target, {r('price - dir * CASE WHEN atr > 0 THEN atr * 1.5 ELSE price * 0.01 END')} AS invalidation FROM sc"""


_CARD = """SELECT s.symbol, s.session, count(*) AS n, {long} AS long_pct, {hod} AS hod_pct, {lod} AS lod_pct, {both} AS both_pct, {none} AS neither_pct FROM sr s JOIN dsum d ON d.symbol = s.symbol AND d.day = s.day GROUP BY s.symbol, s.session""".format(
    long=pct("count(*) FILTER (d.direction = 'long')", "count(*)"), hod=pct("count(*) FILTER (hod = session)", "count(*)"), lod=pct("count(*) FILTER (lod = session)", "count(*)"),
    both=pct("count(*) FILTER (hod = session AND lod = session)", "count(*)"), none=pct("count(*) FILTER (hod <> session AND lod <> session)", "count(*)"))
_DIMS = ("session", "day_of_week", "direction", "side")
_SETS = [(a,) for a in _DIMS] + [(a, b) for i, a in enumerate(_DIMS) for b in _DIMS[i + 1 :]]
_EDGES = " UNION ALL ".join(
    "SELECT event_type, " + ", ".join(d if d in s else f"NULL::VARCHAR AS {d}" for d in _DIMS) + f", count(*) AS n, {pct(_WIN, 'count(*)')} AS win_rate, '{{' || " + " || ',' || ".join(f"""'"{d}":"' || {d} || '"'""" for d in s) + " || '}' AS filters FROM ev WHERE " + " AND ".join(f"{d} IS NOT NULL" for d in s) + " GROUP BY event_type, " + ", ".join(s)
    for s in _SETS
)
_ZONES = [("London Silver Bullet", 420, 480), ("London Open", 420, 540), ("NY Open", 720, 840), ("NY AM Silver Bullet", 840, 900), ("NY PM Silver Bullet", 1080, 1140)]
_TOUCH = value_area("e_") + f""", c AS (SELECT split_part(k, '|', 1) AS symbol, CAST(split_part(k, '|', 2) AS TIMESTAMP)::DATE AS day, {r('poc')} AS poc, {r('vah')} AS vah, {r('val')} AS val, total_tpos, k FROM prof),
    o AS (SELECT k, arg_min(open, bar_ts) AS ro, arg_max(close, bar_ts) AS rc FROM rth GROUP BY k), d AS (SELECT c.*, ro, rc, lag(poc) OVER w AS pp, lag(vah) OVER w AS ph, lag(val) OVER w AS pl FROM c JOIN o USING (k) WINDOW w AS (PARTITION BY symbol ORDER BY day)),
    t AS (SELECT d.symbol, d.day, ro, rc, poc, vah, val, pp, ph, pl, total_tpos, min(bar_ts) FILTER (low <= pp AND pp <= high) AS a, min(bar_ts) FILTER (low <= ph AND ph <= high) AS b, min(bar_ts) FILTER (low <= pl AND pl <= high) AS e FROM d LEFT JOIN b60 x ON x.symbol = d.symbol AND x.bar_ts::DATE = d.day AND hour(bar_ts) * 60 >= 810 AND hour(bar_ts) * 60 < 1200 GROUP BY ALL)"""

ORACLES |= {
    "tpo02_tick": sql(f"SELECT {_UNKEY}, hi, lo, n, s AS start_ts, e AS end_ts, tick, b AS bottom, t AS top, rows FROM q_s"),
    "tpo03_rows": sql(f"SELECT {_UNKEY}, j, price, cnt AS n, letters FROM q_r"),
    "tpo05_zones": sql(value_area("q_") + f" SELECT {_UNKEY.replace('k,', 'z.k,')}, j, price, cnt AS n, letters, CASE WHEN j = poc_j THEN 'poc' WHEN j BETWEEN val_j AND vah_j THEN 'value' ELSE 'outside' END AS zone FROM q_r z JOIN prof ON prof.k = z.k WHERE cnt > 0"),
    "tpo06_value_area": sql(value_area("q_") + f" SELECT {_UNKEY}, * EXCLUDE (k) FROM prof"),
    "tpo06_value_area_5m": sql(value_area("f_") + f" SELECT {_UNKEY}, * EXCLUDE (k) FROM prof"),
    "eth01_touches": sql(_TOUCH + """ SELECT symbol, CAST(day AS VARCHAR) AS day, ro AS rth_open, rc AS rth_close, poc, vah, val, pp AS prev_poc, ph AS prev_vah, pl AS prev_val, total_tpos, a IS NOT NULL AS touched_poc, b IS NOT NULL AS touched_vah, e IS NOT NULL AS touched_val,
        strftime(a, '%H:%M') AS poc_time, strftime(b, '%H:%M') AS vah_time, strftime(e, '%H:%M') AS val_time, dayname(day) AS day_of_week FROM t"""),
    "d17_touch_rates": sql(_TOUCH + f" SELECT symbol, count(*) AS days, {pct('count(a)', 'count(*)')} AS poc_pct, {pct('count(b)', 'count(*)')} AS vah_pct, {pct('count(e)', 'count(*)')} AS val_pct FROM t GROUP BY symbol"),
    "of01_levels": sql(_FLOW.format(where="") + " SELECT * FROM lv"),
    "of01_footprint_map": sql(_FLOW.format(where="") + " SELECT symbol, bar_ts, count(*) AS levels, sum(buy_vol) AS buy FROM lv GROUP BY ALL"),
    "of02_delta": sql(_FLOW.format(where="") + _DELTA.format(more="")),
    "of03_large": sql(f"SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bar_ts, ts, price, qty, {r('price * qty')} AS quote, CASE WHEN is_buyer_maker THEN 'sell' ELSE 'buy' END AS side FROM ticks WHERE price * qty >= 10000 QUALIFY row_number() OVER (PARTITION BY symbol, bar_ts ORDER BY ts DESC, trade_id DESC) <= 50"),
    "of04_last_bars": sql(_FLOW.format(where="WHERE ts >= TIMESTAMP '2024-01-19 23:00:00' AND ts <= TIMESTAMP '2024-01-20 10:30:00'") + _DELTA.format(more=", bar_ts = TIMESTAMP '2024-01-20 10:00:00' AS truncated")),
    "drv01_funding": f"SELECT n_name AS symbol, {r('(n_nationkey - 12) / 10000.0::DOUBLE * 100')} AS rate_pct, {r('(n_nationkey - 12) / 10000.0::DOUBLE * 3 * 365 * 100', 4)} AS annual_pct, {r('32.0::DOUBLE - n_nationkey', 2)} AS hours_to_next FROM nation",
    "drv02_changes": sql("WITH d AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, count(*)::DOUBLE AS oi, count(*) FILTER (o_orderstatus = 'F') / greatest(count(*) FILTER (o_orderstatus <> 'F'), 1)::DOUBLE AS ratio, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS buy_vol FROM orders GROUP BY 1), m AS (SELECT *, date_trunc('month', ts)::TIMESTAMP AS month FROM d) " + " UNION ALL ".join(
        f"SELECT month, n, {r('f')} AS first, {r('l')} AS last, {r('c', 4)} AS change_pct, CASE WHEN c > 1 THEN 'rising' WHEN c < -1 THEN 'falling' ELSE 'flat' END AS trend, '{x}' AS series FROM (SELECT *, CASE WHEN f <> 0 THEN (l - f) / f * 100 ELSE 0 END AS c FROM (SELECT month, count(*) AS n, arg_min({x}, ts) AS f, arg_max({x}, ts) AS l FROM m GROUP BY month))" for x in ("oi", "ratio", "buy_vol"))),
    "pos01_sizes": f"""WITH q AS (SELECT c_custkey AS request_id, abs(c_acctbal) + 1 AS equity, 0.5::DOUBLE + (c_custkey % 5) * 0.5::DOUBLE AS risk_pct, 100.0::DOUBLE + c_custkey % 50 AS e, 100.0::DOUBLE + c_custkey % 50 + CASE WHEN c_custkey % 2 = 0 THEN -5 ELSE 4 END AS s, CASE WHEN c_custkey % 3 <> 0 THEN 100.0::DOUBLE + c_custkey % 50 + CASE WHEN c_custkey % 2 = 0 THEN 15 ELSE -10 END END AS t, 1 + c_custkey % 10 AS lev FROM customer)
        SELECT request_id, CASE WHEN s < e THEN 'long' ELSE 'short' END AS side, {r('equity * risk_pct / 100', 4)} AS risk, {r('equity * risk_pct / 100 / abs(e - s)')} AS units, {r('equity * risk_pct / 100 / abs(e - s) * e', 4)} AS notional, {r('equity * risk_pct / 100 / abs(e - s) * e / lev', 4)} AS margin, {r('abs(t - e) / abs(e - s)', 4)} AS rr, {r('100.0::DOUBLE / (1 + abs(t - e) / abs(e - s))', 4)} AS breakeven_pct, NULL::VARCHAR AS error FROM q""",
    "clk01_clock": "WITH m AS (SELECT event_id, ts, (hour(ts) * 60 + minute(ts) + second(ts) / 60.0::DOUBLE)::DOUBLE AS m FROM events) SELECT event_id, ts, CASE WHEN m < 480 THEN 'asia' WHEN m < 780 THEN 'london' WHEN m < 1260 THEN 'new_york' ELSE 'post_ny' END AS session, "
        "CASE WHEN m < 480 THEN CASE WHEN m < 160 THEN 'early' WHEN m < 320 THEN 'middle' ELSE 'late' END WHEN m < 780 THEN CASE WHEN m < 580 THEN 'early' WHEN m < 680 THEN 'middle' ELSE 'late' END WHEN m < 1260 THEN CASE WHEN m < 940 THEN 'early' WHEN m < 1100 THEN 'middle' ELSE 'late' END END AS phase, "
        "CASE WHEN m < 480 THEN 'london' WHEN m < 780 THEN 'new_york' ELSE 'asia' END AS next_session, CAST(floor(CASE WHEN m < 480 THEN 480 - m WHEN m < 780 THEN 780 - m ELSE 1440 - m END + 0.5) AS BIGINT) AS next_in, CASE "
        + " ".join(f"WHEN m >= {a} AND m < {b} THEN '{n}'" for n, a, b in _ZONES) + " END AS killzone, CASE " + " ".join(f"WHEN m < {a} THEN '{n}'" for n, a, b in _ZONES) + " ELSE 'London Silver Bullet' END AS next_killzone, CAST(floor(CASE " + " ".join(f"WHEN m < {a} THEN {a} - m" for n, a, b in _ZONES) + " ELSE 1860 - m END + 0.5) AS BIGINT) AS killzone_in FROM m",
    "evt01_events": sql("SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM sev"),
    "bt01_backtest": sql(_freq("", "aev")),
    "bt01_filtered": sql(_freq("", "aev", "WHERE session = 'london' AND (day_of_week = 'Tuesday' OR starts_with(event_type, 'smc_'))")),
    "d13_weekdays": sql(_freq(", day_of_week", "sev")),
    "rr03_trades": sql("SELECT * REPLACE (CAST(day AS VARCHAR) AS day, bar_idx::DOUBLE AS bar_idx, bars_held::DOUBLE AS bars_held) FROM sim"),
    "rr04_skips": sql("SELECT event_type, coalesce(skip, 'traded') AS reason, count(*) AS n FROM sim GROUP BY ALL"),
    "d28_equity": sql(f"""WITH c AS (SELECT *, sum(r) OVER w AS cum FROM sim WHERE skip IS NULL WINDOW w AS (PARTITION BY symbol, event_type ORDER BY bar_idx, day, event_type, session NULLS FIRST ROWS UNBOUNDED PRECEDING)), d AS (SELECT *, greatest(max(cum) OVER w, 0) - cum AS dd FROM c WINDOW w AS (PARTITION BY symbol, event_type ORDER BY bar_idx, day, event_type, session NULLS FIRST ROWS UNBOUNDED PRECEDING))
        SELECT symbol, event_type, count(*) AS trades, count(*) FILTER (r > 0) AS wins, count(*) FILTER (r < 0) AS losses, coalesce({r('count(*) FILTER (r > 0) * 100.0::DOUBLE / count(*)', 2)}, 0) AS win_rate, coalesce({r('avg(r) FILTER (r > 0)', 4)}, 0) AS avg_win, coalesce({r('avg(r) FILTER (r < 0)', 4)}, 0) AS avg_loss, {r('avg(r)', 4)} AS expectancy,
        {r('coalesce(sum(r) FILTER (r > 0), 0) / nullif(-sum(r) FILTER (r < 0), 0)', 4)} AS profit_factor, {r('sum(r)', 4)} AS total_r, {r('max(dd)', 4)} AS max_drawdown FROM d GROUP BY ALL"""),
    "e24_downsampled": sql(f"""WITH c AS (SELECT symbol, row_number() OVER w - 1 AS k, sum(r) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, count(*) OVER (PARTITION BY symbol) AS n FROM sim WHERE skip IS NULL WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx, day, event_type, session NULLS FIRST))
        SELECT symbol, k, {r('cum', 6)} AS cum FROM c WHERE n <= 50 OR k IN (SELECT round_even(i * (n - 1) / 49.0::DOUBLE, 0)::BIGINT FROM range(0, 50) t(i))"""),
    "edg01_edges": sql(f"""WITH ev AS (SELECT * FROM aev WHERE event_type <> 'session_range'), base AS (SELECT event_type, {pct(_WIN, 'count(*)')} AS baseline FROM ev GROUP BY event_type), cell AS ({_EDGES})
        SELECT event_type, session, day_of_week, direction, side, n, win_rate, baseline, {r('(win_rate - baseline) * sqrt(n)', 2)} AS edge_score, filters FROM cell JOIN base USING (event_type) WHERE n >= 10"""),
    "d23_session_card": sql(_CARD),
    "d26_forecast": sql(f"""WITH o AS (SELECT symbol, session, count(*) AS n, {r(f'quantile_cont({r("(high - low) / low * 100", 3)}, 0.25)', 6)} AS low_pct, {r(f'quantile_cont({r("(high - low) / low * 100", 3)}, 0.5)', 6)} AS median_pct, {r(f'quantile_cont({r("(high - low) / low * 100", 3)}, 0.75)', 6)} AS high_pct, {pct('count(*) FILTER (close > open)', 'count(*)')} AS bullish_pct FROM sr GROUP BY ALL),
        p AS (SELECT symbol, CASE session WHEN 'asia' THEN 'london' ELSE 'new_york' END AS session, count(*) AS d FROM sr WHERE session <> 'new_york' GROUP BY ALL),
        s AS (SELECT symbol, session, count(*) AS k, count(*) FILTER (swept_side <> 'low') AS h, count(*) FILTER (swept_side <> 'high') AS l FROM swp GROUP BY ALL), c AS (SELECT symbol, arg_max(close, bar_ts) AS price FROM b60 GROUP BY symbol)
        SELECT symbol, session, n, low_pct, median_pct, high_pct, bullish_pct, {pct('coalesce(k, 0)', 'coalesce(d, 0)')} AS sweep_pct, CASE WHEN h > l THEN 'high' WHEN l > h THEN 'low' WHEN k IS NOT NULL THEN 'either' END AS likely_side, {r('price + price * median_pct / 100.0::DOUBLE / 2.0::DOUBLE')} AS projected_high, {r('price - price * median_pct / 100.0::DOUBLE / 2.0::DOUBLE')} AS projected_low
        FROM o LEFT JOIN p USING (symbol, session) LEFT JOIN s USING (symbol, session) JOIN c USING (symbol)"""),
    "cnf01_grades": sql(_confluence(0.5)),
    "cnf01_grades_wide": sql(_confluence(60.0)),
    "scan01_ranking": sql(_confluence(60.0).replace("SELECT k AS symbol, as_of, price", "SELECT row_number() OVER (ORDER BY score DESC, score >= 6 AND NOT (counter AND score < 8) DESC, counter, k) AS rank, k AS symbol").split("CASE WHEN has_ob THEN concat_ws")[0].rstrip().rstrip(",").replace("counter AS is_counter_trend, ", "") + " FROM sc"),
}
del VIEWS["eth"]
