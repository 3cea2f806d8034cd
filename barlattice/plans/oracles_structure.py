"""SQL for patterns, bias, concepts, levels and market structure."""

from __future__ import annotations

from .oracles import ORACLES, VIEWS, pct, r, sql


def structure_views(p: str, source: str, swing: int, internal: int) -> dict[str, str]:
    """Views with prefix ``p`` over ``source(k, i, bar_ts, open, high, low, close)``,
    one series per ``k``: written with joins where the engine uses windows."""

    def pivots(n: int) -> str:
        return f"""SELECT a.k, a.i, a.bar_ts, unnest(CASE WHEN hi AND lo THEN ['high', 'low'] WHEN hi THEN ['high'] ELSE ['low'] END) AS side, a.high, a.low FROM (
            SELECT a.k, a.i, a.bar_ts, a.high, a.low, max(b.high) FILTER (b.i < a.i) <= a.high AND max(b.high) FILTER (b.i > a.i) < a.high AS hi, min(b.low) FILTER (b.i < a.i) >= a.low AND min(b.low) FILTER (b.i > a.i) > a.low AS lo
            FROM {source} a JOIN {source} b ON a.k = b.k AND b.i BETWEEN a.i - {n} AND a.i + {n} AND b.i <> a.i GROUP BY a.k, a.i, a.bar_ts, a.high, a.low HAVING count(*) = {2 * n}) a WHERE hi OR lo"""

    def crossing(piv: str, ahead: int) -> str:
        return f"""SELECT z.*, e.price, e.i AS pi FROM (SELECT st.k, st.seq, st.side, st.ps, min(b.i) AS x FROM (SELECT e.k, e.seq, e.i, q.side, max(q.seq) AS ps FROM {piv} e JOIN {piv} q ON q.k = e.k AND q.seq <= e.seq GROUP BY ALL) st
            JOIN {piv} q ON q.k = st.k AND q.seq = st.ps JOIN {source} b ON b.k = st.k AND b.i > st.i AND b.i <= st.i + {ahead} AND CASE WHEN st.side = 'high' THEN b.close > q.price ELSE b.close < q.price END
            GROUP BY st.k, st.seq, st.side, st.ps QUALIFY row_number() OVER (PARTITION BY st.k, st.ps ORDER BY st.seq) = 1) z JOIN {piv} e ON e.k = z.k AND e.seq = z.ps"""

    def ordered(name: str) -> str:
        return f"SELECT *, CASE WHEN side = 'high' THEN high ELSE low END AS price, row_number() OVER (PARTITION BY k ORDER BY i, side) AS seq FROM ({name})"

    def breaks(cross: str) -> str:
        return f"""SELECT k, row_number() OVER o AS ord, CASE WHEN lag(side) OVER o <> side THEN 'CHoCH' ELSE 'BOS' END AS type, CASE side WHEN 'high' THEN 1 ELSE -1 END AS bias, price AS level, pi AS start_index, x AS end_index
            FROM {cross} WINDOW o AS (PARTITION BY k ORDER BY seq, side)"""

    def origin(rows: str, bull_low: bool) -> str:
        low = "bias = 1" if bull_low else "bias = -1"
        return f"""SELECT t.k, t.ord, t.bias, t.end_index, CASE WHEN {low} THEN arg_min(b.i, row(b.low, b.i)) ELSE arg_min(b.i, row(-b.high, b.i)) END AS oi FROM ({rows}) t JOIN {source} b ON b.k = t.k AND b.i BETWEEN t.start_index - 10 AND t.start_index GROUP BY t.k, t.ord, t.bias, t.end_index"""

    last20 = f"SELECT * FROM {p}st QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord DESC) <= 20"
    return {
        f"{p}ps": ordered(pivots(swing)),
        f"{p}pi": ordered(pivots(internal)),
        f"{p}xs": crossing(f"{p}ps", 49),
        f"{p}xi": crossing(f"{p}pi", 49),
        f"{p}bs": breaks(f"{p}xs"),
        f"{p}bi": breaks(f"{p}xi"),
        f"{p}st": f"SELECT * REPLACE (row_number() OVER (PARTITION BY k ORDER BY pass, ord) AS ord) FROM (SELECT *, 0 AS pass FROM {p}bs UNION ALL SELECT *, 1 FROM {p}bi)",
        f"{p}tr": f"SELECT k, arg_max(bias, ord) AS trend_bias FROM {p}bi GROUP BY k",
        f"{p}fg": f"""SELECT k, bar_index, bar_ts, bias, top, bottom FROM (SELECT c.k, m.i AS bar_index, m.bar_ts, CASE WHEN c.low > a.high THEN 1 ELSE -1 END AS bias, CASE WHEN c.low > a.high THEN c.low ELSE a.low END AS top, CASE WHEN c.low > a.high THEN a.high ELSE c.high END AS bottom
            FROM {source} c JOIN {source} a ON a.k = c.k AND a.i = c.i - 2 JOIN {source} m ON m.k = c.k AND m.i = c.i - 1 WHERE c.low > a.high OR c.high < a.low) g
            WHERE NOT EXISTS (SELECT 1 FROM {source} b WHERE b.k = g.k AND b.i > g.bar_index + 1 AND CASE g.bias WHEN 1 THEN b.low < g.bottom ELSE b.high > g.top END)
            QUALIFY row_number() OVER (PARTITION BY k ORDER BY bar_index DESC, bias) <= 20""",
        f"{p}ob": f"""SELECT o.k, o.ord, o.oi AS bar_index, b.bar_ts, b.high AS ob_high, b.low AS ob_low, o.bias FROM ({origin(last20, True)}) o JOIN {source} b ON b.k = o.k AND b.i = o.oi
            WHERE NOT EXISTS (SELECT 1 FROM {source} f WHERE f.k = o.k AND f.i > o.oi AND CASE o.bias WHEN 1 THEN f.low < b.low ELSE f.high > b.high END) QUALIFY row_number() OVER (PARTITION BY o.k ORDER BY o.ord DESC) <= 10""",
        f"{p}eq": f"""SELECT k, row_number() OVER (PARTITION BY k ORDER BY side, d > 1, i, d DESC) AS ord, CASE side WHEN 'high' THEN 'EQH' ELSE 'EQL' END AS type, (price + pp) / 2 AS level, pi AS prev_index, i AS curr_index FROM (
            SELECT a.k, a.side, a.i, a.price, b.price AS pp, b.i AS pi, a.n - b.n AS d FROM (SELECT *, row_number() OVER (PARTITION BY k, side ORDER BY i) AS n FROM {p}ps) a JOIN (SELECT *, row_number() OVER (PARTITION BY k, side ORDER BY i) AS n FROM {p}ps) b
            ON a.k = b.k AND a.side = b.side AND a.n - b.n BETWEEN 1 AND 3) WHERE abs(price - pp) / ((price + pp) / 2) < 0.003""",
        f"{p}lq": f"""SELECT t.k, t.i AS pivot_index, t.price AS level, b.i AS bar_index, b.bar_ts, CASE t.side WHEN 'high' THEN b.high ELSE b.low END AS sweep_price, CASE t.side WHEN 'high' THEN -1 ELSE 1 END AS bias FROM (
            SELECT q.k, q.i, q.side, q.price, min(b.i) FILTER (CASE q.side WHEN 'high' THEN b.close > q.price ELSE b.close < q.price END) AS killed, min(b.i) FILTER (CASE q.side WHEN 'high' THEN b.high > q.price AND b.close < q.price ELSE b.low < q.price AND b.close > q.price END) AS wick
            FROM {p}pi q JOIN {source} b ON b.k = q.k AND b.i BETWEEN q.i + {internal} AND q.i + 2000 GROUP BY ALL) t JOIN {source} b ON b.k = t.k AND b.i = t.wick WHERE killed IS NULL OR wick < killed""",
        f"{p}bb": f"""SELECT o.k, o.ord, o.oi AS bar_index, b.bar_ts, b.high AS ob_high, b.low AS ob_low, o.bias FROM ({origin(f'SELECT * FROM {p}st', False)}) o JOIN {source} b ON b.k = o.k AND b.i = o.oi
            WHERE EXISTS (SELECT 1 FROM {source} f WHERE f.k = o.k AND f.i > o.oi AND f.i < o.end_index AND CASE o.bias WHEN 1 THEN f.high > b.high ELSE f.low < b.low END)
            AND EXISTS (SELECT 1 FROM {source} f WHERE f.k = o.k AND f.i BETWEEN o.end_index AND o.end_index + 29 AND CASE o.bias WHEN 1 THEN f.low <= b.high AND f.close >= b.low ELSE f.high >= b.low AND f.close <= b.high END)
            QUALIFY row_number() OVER (PARTITION BY o.k ORDER BY o.ord DESC) <= 10""",
        f"{p}x9": crossing(f"{p}pi", 9),
    }


VIEWS["m15"] = "SELECT symbol AS k, i, bar_ts, open, high, low, close FROM b15i"
VIEWS |= structure_views("m_", "m15", 20, 5)
VIEWS["w60"] = """SELECT symbol || '/' || w AS k, symbol, w, b.i - w AS i, bar_ts, open, high, low, close FROM b60i b JOIN (SELECT symbol, unnest(range(0, n - 200, 50)) AS w FROM (SELECT symbol, count(*) AS n FROM b60i GROUP BY symbol)) USING (symbol) WHERE b.i BETWEEN w AND w + 199"""
VIEWS |= structure_views("w_", "w60", 20, 5)
VIEWS["wf"] = """SELECT * FROM (SELECT *, split_part(k, '/', 1) AS symbol, CAST(split_part(k, '/', 2) AS BIGINT) AS w, CAST(split_part(k, '/', 2) AS BIGINT) + at_ AS idx FROM (
    SELECT k, 'ob' AS kind, bar_index AS at_, ord, bias, NULL::DOUBLE AS level, ob_high AS top, ob_low AS bottom FROM w_ob UNION ALL SELECT k, 'fvg', bar_index, -bias, bias, NULL, top, bottom FROM w_fg
    UNION ALL SELECT k, lower(type), end_index, ord, bias, level, NULL, NULL FROM w_st UNION ALL SELECT k, 'eq', curr_index, ord, CASE type WHEN 'EQH' THEN -1 ELSE 1 END, level, NULL, NULL FROM w_eq
    UNION ALL SELECT k, 'sweep', bar_index, pivot_index + 1000000 * bias, bias, level, NULL, NULL FROM w_lq)) QUALIFY row_number() OVER (PARTITION BY symbol, kind, idx ORDER BY w, ord) = 1"""
VIEWS["wa"] = """SELECT f.symbol, f.kind, f.idx, f.w, f.bias, f.level, f.top, f.bottom, b.i, b.i - f.idx AS d, b.high, b.low, b.close FROM wf f JOIN b60i b ON b.symbol = f.symbol AND b.i > f.idx AND b.i < f.w + 248
    AND b.i <= f.idx + CASE f.kind WHEN 'ob' THEN 24 WHEN 'fvg' THEN 48 WHEN 'bos' THEN 8 WHEN 'choch' THEN 12 WHEN 'eq' THEN 6 ELSE 12 END"""
VIEWS["wob"] = """SELECT symbol, kind, idx, min(d) FILTER (away >= 3 AND touch) AS rd, arg_min(hold, d) FILTER (away >= 3 AND touch) AS held FROM (SELECT *, CASE bias WHEN 1 THEN low <= top ELSE high >= bottom END AS touch, CASE bias WHEN 1 THEN close >= bottom ELSE close <= top END AS hold,
    count(*) FILTER (CASE bias WHEN 1 THEN low > top ELSE high < bottom END) OVER (PARTITION BY symbol, kind, idx ORDER BY i) AS away FROM wa WHERE kind = 'ob') GROUP BY symbol, kind, idx"""
VIEWS["wsw"] = "SELECT symbol, kind, idx, min(i) AS si FROM wa WHERE kind = 'eq' AND CASE bias WHEN 1 THEN low < level ELSE high > level END GROUP BY ALL"
VIEWS["wev"] = f"""SELECT a.symbol, a.kind, a.idx, z.bar_ts, a.w AS win, a.bias, a.level, a.top, a.bottom, CASE WHEN a.kind = 'ob' THEN any_value(o.rd) IS NOT NULL END AS retested, CASE WHEN a.kind = 'ob' THEN coalesce(any_value(o.rd), 0) END AS retested_within, CASE WHEN a.kind = 'ob' THEN coalesce(any_value(o.held), false) END AS held,
    CASE WHEN a.kind = 'fvg' THEN count(*) FILTER (d > 3 AND CASE a.bias WHEN 1 THEN a.low <= a.top ELSE a.high >= a.bottom END) > 0 END AS filled, CASE WHEN a.kind = 'fvg' THEN coalesce(min(d) FILTER (d > 3 AND CASE a.bias WHEN 1 THEN a.low <= a.top ELSE a.high >= a.bottom END), 0) END AS filled_within,
    CASE WHEN a.kind = 'fvg' THEN {r("coalesce(max(CASE a.bias WHEN 1 THEN a.top - greatest(a.low, a.bottom) ELSE least(a.high, a.top) - a.bottom END) FILTER (d > 3 AND CASE a.bias WHEN 1 THEN a.low <= a.top ELSE a.high >= a.bottom END) / (a.top - a.bottom) * 100, 0)", 2)} END AS filled_pct,
    CASE WHEN a.kind = 'eq' THEN any_value(s.si) IS NOT NULL END AS swept,
    CASE WHEN a.kind NOT IN ('ob', 'fvg') THEN coalesce(max(CASE WHEN a.bias = 1 AND a.high > a.level THEN abs(a.high - a.level) / a.level * 100 WHEN a.bias = -1 AND a.low < a.level THEN abs(a.low - a.level) / a.level * 100 ELSE 0 END) FILTER (a.kind <> 'eq' OR a.i >= s.si), 0) END AS far
    FROM wa a JOIN b60i z ON z.symbol = a.symbol AND z.i = a.idx LEFT JOIN wob o ON o.symbol = a.symbol AND o.kind = a.kind AND o.idx = a.idx LEFT JOIN wsw s ON s.symbol = a.symbol AND s.kind = a.kind AND s.idx = a.idx GROUP BY a.symbol, a.kind, a.idx, z.bar_ts, a.w, a.bias, a.level, a.top, a.bottom"""
VIEWS["wout"] = f"""SELECT e.* EXCLUDE (far), {r('far', 4)} AS max_move_pct, CASE kind WHEN 'bos' THEN far >= 0.3 WHEN 'choch' THEN far >= 0.5 WHEN 'eq' THEN far >= 0.3 WHEN 'sweep' THEN far >= 1.0 END AS success,
    CASE WHEN hour(bar_ts) < 8 THEN 'asia' WHEN hour(bar_ts) < 13 THEN 'london' WHEN hour(bar_ts) < 21 THEN 'new_york' ELSE 'off_hours' END AS session, CASE WHEN kind NOT IN ('eq', 'sweep') THEN CASE WHEN coalesce(trend_bias, 0) = 1 THEN 'bullish' ELSE 'bearish' END END AS trend_at_formation
    FROM wev e LEFT JOIN w_tr t ON t.k = e.symbol || '/' || e.win"""


def _fractal(side: str, op: str) -> str:
    x = side
    return f"""(coalesce(p2.{x} {op} c.{x}, false) AND p1.{x} {op} c.{x} AND n2.{x} IS NOT NULL AND ((n1.{x} {op} c.{x} AND n2.{x} {op} c.{x}) OR coalesce(n3.{x} {op} c.{x} AND n2.{x} {op} c.{x} AND n1.{x} = c.{x}, false)
        OR coalesce(n4.{x} {op} c.{x} AND n3.{x} {op} c.{x} AND n2.{x} = c.{x} AND n1.{x} {op}= c.{x}, false) OR coalesce(n5.{x} {op} c.{x} AND n4.{x} {op} c.{x} AND n3.{x} = c.{x} AND n2.{x} = c.{x} AND n1.{x} {op}= c.{x}, false)))"""


_NEAR = " ".join(f"LEFT JOIN m15 {n} ON {n}.k = c.k AND {n}.i = c.i {d}" for n, d in (("p2", "- 2"), ("p1", "- 1"), ("n1", "+ 1"), ("n2", "+ 2"), ("n3", "+ 3"), ("n4", "+ 4"), ("n5", "+ 5")))


def _labels(rows: str, eh: str, el: str) -> str:
    return f"""SELECT symbol, side, i, bar_ts, price, label, CASE WHEN label IN ('HH', 'HL') THEN 1 WHEN label IN ('LH', 'LL') THEN -1 ELSE 0 END AS bias FROM (
        SELECT *, CASE WHEN price > pp THEN CASE side WHEN 'high' THEN 'HH' ELSE 'HL' END WHEN price < pp THEN CASE side WHEN 'high' THEN 'LH' ELSE 'LL' END WHEN side = 'high' THEN '{eh}' ELSE '{el}' END AS label
        FROM (SELECT k AS symbol, side, i, bar_ts, price, lag(price) OVER (PARTITION BY k, side ORDER BY i) AS pp FROM ({rows})) WHERE pp IS NOT NULL)"""


def _patterns(source: str, spans: str) -> str:
    label = {
        "doji": ("doji",) * 3, "marubozu": ("bullish marubozu", "bearish marubozu", ""), "spinning_top": ("spinning top",) * 3, "hammer": ("hammer / hanging man",) * 3, "shooting_star": ("shooting star / inverted hammer",) * 3,
        "engulfing": ("bullish engulfing", "bearish engulfing", ""), "harami": ("bullish harami", "bearish harami", ""), "piercing_darkcloud": ("piercing line", "dark cloud cover", ""), "inside_bar": ("inside bar",) * 3,
        "outside_bar": ("bullish outside bar", "bearish outside bar", "outside bar"), "star": ("morning star", "evening star", ""), "three_soldiers_crows": ("three white soldiers", "three black crows", ""),
    }
    names = " ".join(f"WHEN '{k}' THEN CASE direction WHEN 'bullish' THEN '{a}' WHEN 'bearish' THEN '{b}' ELSE '{c}' END" for k, (a, b, c) in label.items())
    bars = ", ".join(f"lag({c}, {n}) OVER w AS {c[0]}{n}" for n in (1, 2) for c in ("open", "high", "low", "close"))
    share = lambda x: f"CASE WHEN high > low THEN ({x}) / (high - low) ELSE 0 END"
    return f"""WITH b AS (SELECT *, {bars}, {share('high - greatest(open, close)')} AS uw, {share('least(open, close) - low')} AS lw, {share('abs(close - open)')} AS br, high > low AS ok FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY i)),
        c AS (SELECT *, lag(br, 1) OVER w AS br1, lag(br, 2) OVER w AS br2, ok AND uw <= 0.05 AND lw <= 0.05 AND br >= 0.9 AS mz FROM b WINDOW w AS (PARTITION BY symbol ORDER BY i)),
        e AS (SELECT *, ok AND NOT mz AND lw >= 0.6 AND uw <= 0.2 AND br <= 0.3 AS hm, ok AND NOT mz AND uw >= 0.6 AND lw <= 0.2 AND br <= 0.3 AS ss,
          CASE WHEN close <> open AND c1 <> o1 THEN CASE WHEN c1 < o1 AND close > open AND close >= o1 AND open <= c1 THEN 'bullish' WHEN c1 > o1 AND close < open AND open >= c1 AND close <= o1 THEN 'bearish' END END AS en FROM c),
        d AS (SELECT symbol, i AS bar_idx, bar_ts, high, low, unnest([
          {{'span': 1, 'ordinal': 0, 'key': 'marubozu', 'direction': CASE WHEN mz THEN CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END END}},
          {{'span': 1, 'ordinal': 1, 'key': 'hammer', 'direction': CASE WHEN hm THEN 'bullish' END}}, {{'span': 1, 'ordinal': 2, 'key': 'shooting_star', 'direction': CASE WHEN ss THEN 'bearish' END}},
          {{'span': 1, 'ordinal': 3, 'key': 'doji', 'direction': CASE WHEN ok AND NOT mz AND NOT hm AND NOT ss AND br <= 0.1 THEN 'neutral' END}},
          {{'span': 1, 'ordinal': 4, 'key': 'spinning_top', 'direction': CASE WHEN ok AND NOT mz AND NOT hm AND NOT ss AND br > 0.1 AND br <= 0.3 AND uw >= 0.25 AND lw >= 0.25 THEN 'neutral' END}},
          {{'span': 2, 'ordinal': 5, 'key': 'engulfing', 'direction': en}},
          {{'span': 2, 'ordinal': 6, 'key': 'harami', 'direction': CASE WHEN en IS NULL AND close <> open AND c1 <> o1 AND abs(close - open) < abs(c1 - o1) AND greatest(open, close) <= greatest(o1, c1) AND least(open, close) >= least(o1, c1) THEN CASE WHEN c1 < o1 AND close > open THEN 'bullish' WHEN c1 > o1 AND close < open THEN 'bearish' END END}},
          {{'span': 2, 'ordinal': 7, 'key': 'piercing_darkcloud', 'direction': CASE WHEN c1 < o1 AND close > open AND open < c1 AND close > (o1 + c1) / 2 AND close < o1 THEN 'bullish' WHEN c1 > o1 AND close < open AND open > c1 AND close > o1 AND close < (o1 + c1) / 2 THEN 'bearish' END}},
          {{'span': 2, 'ordinal': 8, 'key': 'inside_bar', 'direction': CASE WHEN high <= h1 AND low >= l1 THEN 'neutral' END}},
          {{'span': 2, 'ordinal': 9, 'key': 'outside_bar', 'direction': CASE WHEN NOT (high <= h1 AND low >= l1) AND high >= h1 AND low <= l1 THEN CASE WHEN close > open THEN 'bullish' WHEN close < open THEN 'bearish' ELSE 'neutral' END END}},
          {{'span': 3, 'ordinal': 10, 'key': 'star', 'direction': CASE WHEN br1 <= 0.3 THEN CASE WHEN c2 < o2 AND close > open AND greatest(o1, c1) < c2 AND close >= (o2 + c2) / 2 THEN 'bullish' WHEN c2 > o2 AND close < open AND least(o1, c1) > c2 AND close <= (o2 + c2) / 2 THEN 'bearish' END END}},
          {{'span': 3, 'ordinal': 11, 'key': 'three_soldiers_crows', 'direction': CASE WHEN br >= 0.6 AND br1 >= 0.6 AND br2 >= 0.6 THEN CASE WHEN c2 > o2 AND c1 > o1 AND close > open AND c1 > c2 AND close > c1 AND c2 > o1 AND o1 > o2 AND c1 > open AND open > o1 THEN 'bullish'
             WHEN c2 < o2 AND c1 < o1 AND close < open AND c1 < c2 AND close < c1 AND c2 < o1 AND o1 < o2 AND c1 < open AND open < o1 THEN 'bearish' END END}}]) AS x FROM e)
        SELECT symbol, bar_idx, bar_ts, high, low, x.span, x.ordinal, x.key, x.direction, CASE key {names} END AS pattern FROM (SELECT *, x.key AS key, x.direction AS direction FROM d) WHERE x.direction IS NOT NULL AND x.span IN ({spans})"""


def _bias(unit: str) -> str:
    source = "SELECT symbol, bar_ts::DATE AS day, open AS o, high AS h, low AS l, close AS c FROM {b}" if unit == "D" else "SELECT symbol, date_trunc('week', bar_ts)::DATE AS day, arg_min(open, bar_ts) AS o, max(high) AS h, min(low) AS l, arg_max(close, bar_ts) AS c FROM {b} GROUP BY ALL"
    return f"""SELECT t.symbol, t.day, CASE WHEN p.c > q.h THEN 1 WHEN p.c < q.l THEN -1 WHEN p.c > q.l AND p.c < q.h AND p.h > q.h AND p.l > q.l THEN -1 WHEN p.c > q.l AND p.c < q.h AND p.h < q.h AND p.l < q.l THEN 1 WHEN p.h <= q.h AND p.l >= q.l THEN CASE WHEN q.c >= q.o THEN 1 ELSE -1 END ELSE 0 END AS bias,
        q.h AS level_high, q.l AS level_low, t.h >= q.h AS hit_high, t.l <= q.l AS hit_low, t.h >= q.h AND t.c > q.h AS closed_above, t.l <= q.l AND t.c < q.l AS closed_below
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM ({source})) t JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM ({source})) p ON p.symbol = t.symbol AND p.n = t.n - 1
        JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM ({source})) q ON q.symbol = t.symbol AND q.n = t.n - 2"""


VIEWS["biasd"] = _bias("D").replace("{b}", "bd")
VIEWS["biasw"] = _bias("W").replace("{b}", "bd")
VIEWS["bias60"] = _bias("D").replace("{b}", "(SELECT symbol, day::TIMESTAMP AS bar_ts, d_open AS open, d_high AS high, d_low AS low, d_close AS close FROM cd)")
_PARTS = (("a", "h < 7"), ("l", "h >= 7 AND h < 13"), ("n", "h >= 13"), ("u", "h < 5"), ("m", "h >= 7 AND h < 10"), ("d", "h >= 13 AND h < 17"))
VIEWS["ict"] = "SELECT *, dh - dl AS dr, coalesce(avg(dh - dl) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 0) AS adr FROM (SELECT symbol, day, max(high) AS dh, min(low) AS dl, " + ", ".join(
    f"max(high) FILTER ({w}) AS {p}h, min(low) FILTER ({w}) AS {p}l, arg_min(open, bar_ts) FILTER ({w}) AS {p}o, arg_max(close, bar_ts) FILTER ({w}) AS {p}c" for p, w in _PARTS) + " FROM sb GROUP BY symbol, day)"
VIEWS["ictd"] = "SELECT *, mh > uh AS su, ml < ul AS sd, mh - uh > ul - ml AS far FROM ict WHERE ah IS NOT NULL"
VIEWS["ictm"] = """SELECT *, CASE WHEN su AND sd THEN CASE WHEN far THEN 'up_sweep' ELSE 'down_sweep' END WHEN su THEN 'up_sweep' WHEN sd THEN 'down_sweep' ELSE '' END AS mv FROM ictd"""
VIEWS["ictp"] = f"""SELECT symbol, day, 'accumulation' AS phase, uh AS high, ul AS low, '' AS direction, {r('CASE WHEN dr > 0 THEN (uh - ul) / dr * 100 ELSE 0 END', 1)} AS range_pct, CASE WHEN CASE WHEN adr > 0 THEN (uh - ul) / adr * 100 ELSE 0 END < 30 THEN 'clean' WHEN CASE WHEN adr > 0 THEN (uh - ul) / adr * 100 ELSE 0 END > 50 THEN 'messy' ELSE '' END AS quality FROM ictm WHERE uh IS NOT NULL
    UNION ALL SELECT symbol, day, 'manipulation', mh, ml, mv, {r('CASE WHEN dr > 0 THEN (mh - ml) / dr * 100 ELSE 0 END', 1)}, CASE WHEN mv = '' THEN '' WHEN dr > 0 AND (mh - ml) / dr * 100 BETWEEN 20 AND 40 THEN 'clean' ELSE 'messy' END FROM ictm WHERE mh IS NOT NULL AND uh IS NOT NULL
    UNION ALL SELECT symbol, day, 'distribution', wh, wl, dd, {r('CASE WHEN dr > 0 THEN (wh - wl) / dr * 100 ELSE 0 END', 1)}, CASE WHEN dd = '' THEN '' WHEN dr > 0 AND (wh - wl) / dr * 100 BETWEEN 50 AND 70 THEN 'clean' ELSE 'messy' END
      FROM (SELECT symbol, day, dr, dxh AS wh, dxl AS wl, CASE mv WHEN 'up_sweep' THEN 'bearish' WHEN 'down_sweep' THEN 'bullish' ELSE CASE WHEN lc > lo THEN 'bullish' WHEN lc < lo THEN 'bearish' ELSE '' END END AS dd FROM (SELECT *, dh_ AS dxh, dl_ AS dxl FROM ictm2) WHERE dxh IS NOT NULL AND mh IS NOT NULL)"""
# the day's own extremes are dh and dl, so the distribution phase goes by x
VIEWS["ict"] = VIEWS["ict"].replace("AS dh, min(low) FILTER (h >= 13 AND h < 17) AS dl,", "AS dh_, min(low) FILTER (h >= 13 AND h < 17) AS dl_,").replace("AS do, arg_max(close, bar_ts) FILTER (h >= 13 AND h < 17) AS dc", "AS do_, arg_max(close, bar_ts) FILTER (h >= 13 AND h < 17) AS dc_")
VIEWS["ictm2"] = "SELECT * REPLACE (CASE WHEN uh IS NOT NULL AND mh IS NOT NULL THEN mv ELSE '' END AS mv) FROM ictm"
_S = "SELECT k AS symbol, * EXCLUDE (k) FROM"

ORACLES |= {
    "pa01_single": sql(_patterns("b60i", "1")),
    "pa02_double": sql(_patterns("b60i", "2")),
    "pa03_triple": sql(_patterns("b5i", "3")),
    "pa04_counts": sql(f"SELECT pattern, span, count(*) AS n, max(bar_ts) AS newest FROM ({_patterns('b15i', '1, 2, 3')}) GROUP BY ALL"),
    "bias01_daily": sql("SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM biasd"),
    "bias01_weekly": sql("SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM biasw"),
    "d29_bias_statistics": sql(f"""SELECT symbol, count(*) AS n, count(*) FILTER (bias = 1) AS bullish, count(*) FILTER (bias = -1) AS bearish, {pct('count(*) FILTER (bias = 1 AND hit_high)', 'count(*) FILTER (bias = 1)')} AS bull_hit_pct, {pct('count(*) FILTER (bias = -1 AND hit_low)', 'count(*) FILTER (bias = -1)')} AS bear_hit_pct,
        {pct('count(*) FILTER (bias = 1 AND closed_above)', 'count(*) FILTER (bias = 1 AND hit_high)')} AS bull_close_pct, {pct('count(*) FILTER (bias = -1 AND closed_below)', 'count(*) FILTER (bias = -1 AND hit_low)')} AS bear_close_pct FROM biasd GROUP BY symbol"""),
    "ict01_draw": sql("""SELECT symbol, CAST(day AS VARCHAR) AS day, CASE bias WHEN 1 THEN 'bullish' ELSE 'bearish' END AS bias, CASE bias WHEN 1 THEN level_high ELSE level_low END AS dol_price, CASE bias WHEN 1 THEN 'PDH' ELSE 'PDL' END AS dol_label,
        CASE bias WHEN 1 THEN level_low ELSE level_high END AS opposite_price, CASE bias WHEN 1 THEN dh >= level_high ELSE dl <= level_low END AS reached FROM ictd JOIN bias60 USING (symbol, day) WHERE bias <> 0"""),
    "ict02_phases": sql("SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM ictp"),
    "ict03_judas": sql("""SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN up THEN 'up' ELSE 'down' END AS direction, CASE WHEN up THEN mh ELSE ml END AS sweep_price, uh AS asia_high, ul AS asia_low,
        CASE WHEN up THEN coalesce(lc < uh, false) OR (NOT (su AND sd) AND coalesce(nc < uh, false)) ELSE coalesce(lc > ul, false) OR (NOT (su AND sd) AND coalesce(nc > ul, false)) END AS reversal_confirmed
        FROM (SELECT *, CASE WHEN su AND sd THEN far ELSE su END AS up FROM ictd WHERE su OR sd)"""),
    "ict04_session_bias": sql("""SELECT symbol, CAST(day AS VARCHAR) AS day, 'london' AS session, CASE WHEN lh > uh AND ll < ul THEN CASE WHEN lc > uh THEN 'bullish' WHEN lc < ul THEN 'bearish' ELSE 'neutral' END WHEN lh > uh THEN 'bearish' WHEN ll < ul THEN 'bullish' WHEN lc > (uh + ul) / 2 THEN 'bullish' ELSE 'bearish' END AS bias,
        CASE WHEN lh > uh AND ll < ul THEN CASE WHEN lc > uh THEN 'both_above' WHEN lc < ul THEN 'both_below' ELSE 'both_inside' END WHEN lh > uh THEN 'high_swept' WHEN ll < ul THEN 'low_swept' WHEN lc > (uh + ul) / 2 THEN 'none_above_mid' ELSE 'none_below_mid' END AS reason, uh AS target_high, ul AS target_low,
        CASE WHEN lh > uh AND ll < ul THEN lc > uh OR lc < ul WHEN lh > uh THEN lc < uh WHEN ll < ul THEN lc > ul ELSE false END AS hit_target FROM ictd WHERE uh IS NOT NULL AND lh IS NOT NULL
        UNION ALL SELECT symbol, CAST(day AS VARCHAR), 'ny', CASE WHEN nh > lh AND nl >= ll THEN 'bearish' WHEN nl < ll AND nh <= lh THEN 'bullish' WHEN lc > lo THEN 'bullish' ELSE 'bearish' END,
        CASE WHEN nh > lh AND nl >= ll THEN 'london_high_swept' WHEN nl < ll AND nh <= lh THEN 'london_low_swept' WHEN lc > lo THEN 'london_bullish' ELSE 'london_bearish' END, lh, ll,
        CASE WHEN nh > lh AND nl >= ll THEN nc < lh WHEN nl < ll AND nh <= lh THEN nc > ll WHEN lc > lo THEN nh > lh ELSE nl < ll END FROM ictd WHERE lh IS NOT NULL AND nh IS NOT NULL"""),
    "lvl01_levels": sql("""WITH n AS (SELECT symbol, max(bar_ts) AS now FROM b15 GROUP BY symbol), g AS (SELECT symbol, unnest(['D', 'pD', 'W', 'pW', 'M', 'pM', 'd', 'pd']) AS tag, unnest([date_trunc('day', now), date_trunc('day', now) - INTERVAL 1 DAY, date_trunc('week', now), date_trunc('week', now) - INTERVAL 7 DAY,
        date_trunc('month', now), date_trunc('month', date_trunc('month', now) - INTERVAL 1 DAY), date_trunc('day', now), date_trunc('day', now) - INTERVAL 1 DAY])::TIMESTAMP AS s,
        unnest([now + INTERVAL 1 DAY, date_trunc('day', now), now + INTERVAL 1 DAY, date_trunc('week', now), now + INTERVAL 1 DAY, date_trunc('month', now), now + INTERVAL 1 DAY, date_trunc('day', now)])::TIMESTAMP AS e FROM n),
        t AS (SELECT b.*, CASE WHEN lower(tag) = tag THEN replace(tag, 'd', '') || CASE WHEN hour(bar_ts) < 8 THEN 'Asia' WHEN hour(bar_ts) < 13 THEN 'London' ELSE 'NY' END ELSE tag END AS tag FROM g JOIN b15 b ON b.symbol = g.symbol AND bar_ts >= s AND bar_ts < e WHERE NOT (lower(tag) = tag AND hour(bar_ts) >= 21)),
        a AS (SELECT symbol, tag, max(high) AS h, min(low) AS l, arg_min(open, bar_ts) AS o, min(bar_ts) AS o_at, arg_min(bar_ts, row(-high, bar_ts)) AS h_at, arg_min(bar_ts, row(low, bar_ts)) AS l_at FROM t GROUP BY ALL)
        SELECT symbol, tag || ' High' AS label, h AS price, h_at AS "at" FROM a UNION ALL SELECT symbol, tag || ' Low', l, l_at FROM a UNION ALL SELECT symbol, CASE tag WHEN 'D' THEN 'D Open' ELSE 'Mon Open' END, o, o_at FROM a WHERE tag IN ('D', 'W')"""),
    "smc01_pivots": sql("SELECT k AS symbol, i, bar_ts, side, price, 20 AS k FROM m_ps UNION ALL SELECT k, i, bar_ts, side, price, 5 FROM m_pi"),
    "smc02_structure": sql("SELECT k AS symbol, ord, type, bias, level, start_index, end_index, pass FROM m_st"),
    "smc02_trend": sql(f"{_S} m_tr"),
    "smc03_gaps": sql(f"{_S} m_fg"),
    "smc04_order_blocks": sql(f"{_S} m_ob"),
    "smc05_equal_levels": sql(f"SELECT k AS symbol, ord, type, {r('level')} AS level, prev_index, curr_index FROM m_eq"),
    "smc06_swing_labels": sql(_labels("SELECT * FROM m_ps", "LH", "LL")),
    "smc07_fractals": sql(_labels(f"SELECT c.k, c.i, c.bar_ts, 'high' AS side, c.high AS price FROM m15 c {_NEAR} WHERE {_fractal('high', '<')} UNION ALL SELECT c.k, c.i, c.bar_ts, 'low', c.low FROM m15 c {_NEAR} WHERE {_fractal('low', '>')}", "EH", "EL")),
    "smc08_sweeps": sql(f"{_S} m_lq"),
    "smc09_sweep_areas": sql("""WITH q AS (SELECT * FROM m_lq QUALIFY row_number() OVER (PARTITION BY k ORDER BY bar_index DESC, bias DESC, pivot_index DESC) <= 20), e AS (SELECT q.k, q.pivot_index, q.bias, min(b.bar_ts) AS e FROM q JOIN m15 b ON b.k = q.k AND b.i BETWEEN q.bar_index + 2 AND q.bar_index + 299 AND CASE q.bias WHEN -1 THEN b.close > q.sweep_price ELSE b.close < q.sweep_price END GROUP BY ALL)
        SELECT q.k AS symbol, q.pivot_index, q.bar_index AS start_index, greatest(level, sweep_price) AS top, least(level, sweep_price) AS bottom, q.bias, e IS NOT NULL AS broken, coalesce(e, (SELECT max(bar_ts) FROM m15 z WHERE z.k = q.k)) AS end_ts FROM q LEFT JOIN e USING (k, pivot_index, bias)"""),
    "smc10_breakers": sql(f"{_S} m_bb"),
    "smc11_trends": sql("""WITH t AS (SELECT k, x, side, row_number() OVER o AS n, lag(side) OVER o AS ps FROM m_x9 WINDOW o AS (PARTITION BY k ORDER BY seq, side)), u AS (SELECT k, CASE side WHEN 'high' THEN 1 ELSE -1 END AS bias, n, max(x) OVER (PARTITION BY k ORDER BY n) AS eff FROM t WHERE ps IS NULL OR ps <> side)
        SELECT b.k AS symbol, b.i, b.bar_ts, coalesce((SELECT arg_max(bias, n) FROM u WHERE u.k = b.k AND u.eff <= b.i), 0) AS trend FROM m15 b"""),
    "smc12_range": sql("""WITH p AS (SELECT k, arg_max(price, i) FILTER (side = 'high') AS sh, arg_max(price, i) FILTER (side = 'low') AS sl FROM m_ps GROUP BY k), t AS (SELECT k, max(high) AS h50, min(low) AS l50, arg_max(close, i) AS price FROM (SELECT * FROM m15 QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) <= 50) GROUP BY k),
        j AS (SELECT k, CASE WHEN price > sh THEN h50 ELSE sh END AS h, CASE WHEN price < sl THEN l50 ELSE sl END AS l, coalesce(trend_bias, 0) AS b, price FROM p JOIN t USING (k) LEFT JOIN m_tr USING (k) WHERE sh IS NOT NULL AND sl IS NOT NULL)
        SELECT k AS symbol, h AS swing_high, l AS swing_low, b AS trend_bias, CASE WHEN b = 1 THEN l END AS strong_low, CASE WHEN b = 1 THEN h END AS weak_high, CASE WHEN b <> 1 THEN h END AS strong_high, CASE WHEN b <> 1 THEN l END AS weak_low, price FROM j"""),
    "smc15_outcomes": sql("SELECT * REPLACE (" + ", ".join(f"{c}::VARCHAR AS {c}" for c in ("retested", "held", "filled", "swept", "success")) + ", retested_within::DOUBLE AS retested_within, filled_within::DOUBLE AS filled_within) FROM wout"),
    "d11_smc_statistics": sql(f"""SELECT kind, count(*) AS n, {pct("count(*) FILTER (CASE kind WHEN 'ob' THEN held WHEN 'fvg' THEN filled ELSE success END)", 'count(*)')} AS success_pct, {pct('count(*) FILTER (retested)', 'count(*)')} AS retested_pct, {pct('count(*) FILTER (held)', 'count(*) FILTER (retested)')} AS held_pct,
        {pct('count(*) FILTER (swept)', 'count(*)')} AS swept_pct, {r('avg(max_move_pct)', 3)} AS avg_move_pct, {r('avg(filled_within) FILTER (filled)', 3)} AS avg_bars_to_fill FROM wout GROUP BY kind"""),
}
