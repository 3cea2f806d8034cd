"""Events, their frequencies, simulated trades and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import confidence, n_if, over, q, rate
from ..functions.lineage import written_once
from . import indicators as I
from . import outcomes as O
from . import scan as K
from . import sessions as S
from . import structure as T


def session_events(bars: DataFrame) -> DataFrame:
    """Session events as one table; continuation and power of three belong to
    the day, so their session is null."""
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: Column, session: Column, direction: Column, side: Column, win: Column, value: Column) -> DataFrame:
        return df.select("symbol", "day", "day_of_week", kind.alias("event_type"), session.alias("session"), direction.alias("direction"), side.alias("side"), win.alias("win"), value.cast("double").alias("value"))

    ranges = rows(S.session_ranges(bars), F.lit("session_range"), F.col("session"), F.col("direction"), none, F.col("direction") == "bullish", F.col("range_pct"))
    swept = rows(S.sweeps(bars), F.when(F.col("session") == "london", "asia_sweep").otherwise("london_sweep"), F.col("session"), none, F.col("swept_side"), F.col("reversal"), F.col("reversal_distance"))
    cont = rows(S.continuations(bars), F.lit("ny_continuation"), none, F.col("ny_direction"), none, F.col("continuation"), F.col("ny_range"))
    p3 = rows(S.power_of_three(bars), F.lit("power_of_3"), none, F.col("distribution_direction"), F.col("manipulation_side"), F.col("success"), F.col("distribution_distance"))
    return ranges.unionByName(swept).unionByName(cont).unionByName(p3)


def smc_events(bars_idx: DataFrame | None, outcomes: DataFrame | None = None, *more: str) -> DataFrame:
    """Structure outcomes as events, without a weekday, with ``more`` of their columns."""
    e = O.evaluated(bars_idx) if outcomes is None else outcomes
    none = F.lit(None).cast("string")
    won = F.when(F.col("kind") == "ob", F.col("held")).when(F.col("kind") == "fvg", F.col("filled")).otherwise(F.col("success"))
    directed = F.when(F.col("kind").isin("ob", "fvg", "bos", "choch"), F.when(F.col("bias") == 1, "bullish").otherwise("bearish"))
    side = F.when(F.col("kind") == "eq", F.when(F.col("bias") == -1, "EQH").otherwise("EQL")).when(F.col("kind") == "sweep", "WICK")
    return e.select(
        "symbol", F.lit(None).cast("date").alias("day"), none.alias("day_of_week"), F.concat(F.lit("smc_"), "kind", F.lit("_test")).alias("event_type"), "session", directed.alias("direction"), side.alias("side"),
        won.alias("win"), F.coalesce("max_move_pct", "filled_pct").alias("value"), *more,
    )


def facts(bars: DataFrame, bars_idx: DataFrame | None = None, outcomes: DataFrame | None = None) -> DataFrame:
    """All events with ``htf_bias`` (the bias of structure events) and ``tested``
    (an order block's retest, an equal level's sweep). Without indexed bars or
    outcomes, session events alone."""
    text, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    own = session_events(bars).withColumns({"htf_bias": text, "tested": flag})
    if outcomes is None and bars_idx is None:
        return own
    e = (O.evaluated(bars_idx) if outcomes is None else outcomes).withColumn("tested", F.when(F.col("kind") == "ob", F.col("retested")).when(F.col("kind") == "eq", F.col("swept")))
    return own.unionByName(smc_events(None, e, "tested").withColumn("htf_bias", F.col("direction")))


#: Conditions of a backtest and the columns that they ask.
CONDITIONS = {"event_type": "event_type", "session": "session", "day_of_week": "day_of_week", "direction": "direction", "sweep_side": "side", "side": "side", "htf_bias": "htf_bias"}
#: What can be studied, and the matches under which a rate is noise.
EVENT_TYPES = ("asia_sweep", "london_sweep", "ny_continuation", "session_range", "power_of_3", "smc_ob_test", "smc_fvg_test", "smc_bos_test", "smc_choch_test", "smc_eq_test", "smc_sweep_test")
FEW = 5
#: Conditions that are taken and have no effect, since no event carries them.
IGNORED = {"range_state": "events carry no tight or wide range state", "macro_present": "there is no news data"}


def notes(**conditions) -> list[str]:
    """What is to be said about conditions without effect."""
    out = [f"{name}={value!r} ignored: {IGNORED[name]}" for name, value in conditions.items() if name in IGNORED and value not in (None, "")]
    if conditions.get("day_of_week") and str(conditions.get("event_type") or "").startswith("smc_"):
        out.append(f"day_of_week={conditions['day_of_week']!r} ignored: structure events have no weekday")
    return out


def matching(events: DataFrame, **conditions: str | None) -> DataFrame:
    """Events that meet every condition given (CONDITIONS). A weekday is not asked
    of events that have none; IGNORED conditions have no effect (:func:`notes`)."""
    for name, value in conditions.items():
        if name not in CONDITIONS and name not in IGNORED:
            raise ValueError(f"unknown condition {name!r}; known: {', '.join([*CONDITIONS, *IGNORED])}")
        if value and name in CONDITIONS:
            hit = F.col(CONDITIONS[name]) == value
            events = events.where(hit | F.col("event_type").startswith("smc_") if name == "day_of_week" else hit)
    return events


def outcomes(events: DataFrame, *by: str) -> DataFrame:
    """What came of the events (:func:`facts`) of each type: for each its own
    figures, null for those that its type doesn't have."""
    n, won, kind, side = F.count("*"), n_if(F.col("win")), F.col("event_type"), F.col("side")
    sweep, smc = kind.isin("asia_sweep", "london_sweep"), lambda *x: kind.isin(*[f"smc_{k}_test" for k in x])
    tested, up = n_if(F.col("tested")), n_if(F.col("direction") == "bullish")
    mean = lambda places: F.coalesce(F.floor(F.avg(F.floor(F.col("value") * 1e6 + 0.5)) / 10.0 ** (6 - places) + 0.5) / 10.0**places, F.lit(0.0))
    swept = sweep | (kind == "power_of_3")
    figures = {
        "swept_high": F.when(swept, n_if(side == "high")), "swept_low": F.when(swept, n_if(side == "low")), "swept_both": F.when(sweep, n_if(side == "both")),
        "reversal_count": F.when(sweep, won), "reversal_rate": F.when(sweep | smc("choch", "eq"), rate(won, n)).when(kind == "ny_continuation", rate(n - won, n)),
        "continuation_rate": F.when((kind == "ny_continuation") | smc("bos"), rate(won, n)), "bullish_rate": F.when(kind == "session_range", rate(up, n)), "bearish_rate": F.when(kind == "session_range", rate(n - up, n)),
        "avg_range_pct": F.when(kind == "session_range", mean(3)), "success_rate": F.when((kind == "power_of_3") | smc("sweep"), rate(won, n)),
        "retest_rate": F.when(smc("ob"), rate(tested, n)), "hold_rate_when_retested": F.when(smc("ob"), rate(won, tested)), "hold_rate_overall": F.when(smc("ob"), rate(won, n)),
        "fill_rate": F.when(smc("fvg"), rate(won, n)), "avg_fill_pct": F.when(smc("fvg"), mean(1)), "avg_max_move_pct": F.when(smc("bos", "choch", "sweep"), mean(4)),
        "sweep_rate": F.when(smc("eq"), rate(tested, n)), "reversal_rate_when_swept": F.when(smc("eq"), rate(won, tested)),
    }
    return events.groupBy("event_type", *by).agg(n.alias("n"), *[c.alias(k) for k, c in figures.items()], confidence(n).alias("confidence"))


def by_weekday(events: DataFrame) -> DataFrame:
    """Count and success of session events on each weekday."""
    n = F.count("*")
    return events.where(~F.col("event_type").startswith("smc_")).groupBy("event_type", "day_of_week").agg(n.alias("count"), rate(n_if(F.col("win")), n).alias("success_pct"))


def frequencies(events: DataFrame, *by: str) -> DataFrame:
    """How often events of each type come true."""
    n = F.count("*")
    return events.groupBy("event_type", *by).agg(
        n.alias("n"), n_if(F.col("win")).alias("wins"), rate(n_if(F.col("win")), n).alias("win_pct"), n_if(F.col("side") == "high").alias("swept_high"), n_if(F.col("side") == "low").alias("swept_low"),
        n_if(F.col("side") == "both").alias("swept_both"), q(F.avg("value"), 9).alias("avg_value"), confidence(n).alias("confidence"),
    )


def trades(bars: DataFrame, events: DataFrame, *, atr_n: int = 14, stop_mult: float = 1.0, target_r: float = 2.0, hold: int = 48) -> DataFrame:
    """First-touch trades from events: entry at the close of the last bar of the
    confirming session, stop by ATR, target in multiples of it. What cannot be
    traded keeps its row with the reason in ``skip``."""
    idx = I.atr_at_entry(K.numbered(bars, ["symbol"], ["bar_ts"], K.day_of("bar_ts")), atr_n)
    last = S.in_sessions(idx).groupBy("symbol", "day", F.col("session").alias("confirming")).agg(F.max_by(F.struct("bar_idx", F.col("close").alias("entry"), "atr_entry"), "bar_idx").alias("x"))
    at = last.select("symbol", "x.bar_idx").distinct()
    met = T.bars_between(at, idx.select("symbol", F.col("bar_idx").alias("i"), "high", "low", "close"), ("symbol",), F.col("bar_idx") + 1, F.col("bar_idx") + hold)
    ahead = met.groupBy("symbol", "bar_idx").agg(F.array_sort(F.collect_list(F.struct("i", "high", "low", "close"))).alias("ahead"))
    confirming = F.when(F.col("event_type") == "session_range", F.col("session")).when(F.col("event_type") == "asia_sweep", "london").otherwise("new_york")
    side = (
        F.when(F.col("event_type").isin("asia_sweep", "london_sweep"), F.when(F.col("side") == "high", F.when(F.col("win"), "short").otherwise("long")).when(F.col("side") == "low", F.when(F.col("win"), "long").otherwise("short")))
        .otherwise(F.when(F.col("direction") == "bullish", "long").when(F.col("direction") == "bearish", "short"))
    )
    t = events.withColumns({"confirming": confirming, "trade_side": side}).join(last, ["symbol", "day", "confirming"], "left")
    t = t.select("symbol", "day", "event_type", "session", "trade_side", "x.*").join(ahead, ["symbol", "bar_idx"], "left")
    distance = F.col("atr_entry") * stop_mult
    sign = F.when(F.col("trade_side") == "long", 1.0).otherwise(-1.0)
    t = t.withColumns({"distance": distance, "sign": sign, "stop": F.col("entry") - sign * distance, "goal": F.col("entry") + sign * distance * target_r})
    long = F.col("trade_side") == "long"
    stopped = lambda a: F.when(long, a["low"] <= F.col("stop")).otherwise(a["high"] >= F.col("stop"))
    reached = lambda a: F.when(long, a["high"] >= F.col("goal")).otherwise(a["low"] <= F.col("goal"))
    t = t.withColumn("hit", F.get(F.filter("ahead", lambda a: stopped(a) | reached(a)), F.lit(0))).withColumn("end", F.get("ahead", F.size("ahead") - 1))
    skip = (
        F.when(F.col("entry").isNull(), "no_entry_candle").when(F.col("trade_side").isNull(), "no_direction").when(~(F.col("distance") > 0), "zero_atr").when(F.col("ahead").isNull(), "no_forward_bars")
    )
    t = t.withColumn("skip", skip)
    hit = F.col("hit").isNotNull()
    at_stop = F.when(long, F.col("hit.low") <= F.col("stop")).otherwise(F.col("hit.high") >= F.col("stop"))
    at_goal = F.when(long, F.col("hit.high") >= F.col("goal")).otherwise(F.col("hit.low") <= F.col("goal"))
    reason = F.when(hit & at_stop & at_goal, "stop_ambiguous").when(hit & at_stop, "stop").when(hit, "target").otherwise("time")
    r = F.when(hit & at_stop, -1.0).when(hit, target_r).otherwise(F.col("sign") * (F.col("end.close") - F.col("entry")) / F.col("distance"))
    ok = lambda c: F.when(F.col("skip").isNull(), c)
    return t.select(
        "symbol", "day", "event_type", "session", "trade_side", "bar_idx", "entry", ok(q("stop")).alias("stop"), ok(q("goal")).alias("target"), ok(reason).alias("exit_reason"),
        ok(F.coalesce(F.col("hit.i"), F.col("end.i")) - F.col("bar_idx")).cast("int").alias("bars_held"), ok(q(r)).alias("r"), "skip",
    )


#: The order in which trades are entered.
ENTRY = ("bar_idx", "day", "event_type", "session", "symbol")


def equity(done: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of trades in their order of entry, with the largest drawdown
    from a start at zero."""
    t = done.where("skip is null")
    fall = K.worst_fall(t, by, list(ENTRY), K.width_of("bar_idx"), "r")
    r, win, loss = F.col("r"), F.col("r") > 0, F.col("r") < 0
    gross, lost = F.sum(F.when(win, r)), -F.sum(F.when(loss, r))
    figures = t.groupBy(*by).agg(
        F.count("*").alias("trades"), n_if(win).alias("wins"), n_if(loss).alias("losses"), rate(n_if(win), F.count("*"), 2).alias("win_rate"),
        F.coalesce(q(F.avg(F.when(win, r)), 4), F.lit(0.0)).alias("avg_win"), F.coalesce(q(F.avg(F.when(loss, r)), 4), F.lit(0.0)).alias("avg_loss"),
        q(F.avg(r), 4).alias("expectancy"), q(F.try_divide(F.coalesce(gross, F.lit(0.0)), lost), 4).alias("profit_factor"), q(F.sum(r), 4).alias("total_r"),
    )
    return figures.join(fall, by).withColumn("max_drawdown", q("max_drawdown", 4))


def downsampled(done: DataFrame, by: list[str], points: int = 500) -> DataFrame:
    """The running sum of trades at no more than ``points`` even places, first
    and last among them."""
    ordered = done.where("skip is null").select(*dict.fromkeys([*by, *ENTRY, "r"]))
    summed = K.running_sums(ordered, by, list(ENTRY), K.width_of("bar_idx"), {"cum": "r"})
    sizes = ordered.groupBy(*by).agg(F.count("*").alias("n"))
    t = K.numbered(summed, by, list(ENTRY), K.width_of("bar_idx"), "k").join(sizes, by)
    places = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.bround(i * (F.col("n") - 1) / (points - 1)).cast("int"))
    return t.where((F.col("n") <= points) | F.array_contains(places, F.col("k"))).select(*by, "k", q("cum", 6).alias("cum"))


DIMENSIONS = ("session", "day_of_week", "direction", "side")


def baselines(events: DataFrame) -> DataFrame:
    """How often events of each type come true, whatever their cell."""
    return events.where("event_type <> 'session_range'").groupBy("event_type").agg(F.count("*").alias("n"), rate(n_if(F.col("win")), F.count("*")).alias("baseline"))


def extremes(cells: DataFrame, top: int = 15, min_edge_pct: float = 0.0) -> DataFrame:
    """Of the rows of :func:`edges` the ``top`` strongest on either side: ``list``
    (edges, anti_patterns) and ``rank``; cells nearer to their baseline than
    ``min_edge_pct`` go."""
    far = cells.where((F.abs(F.col("win_rate") - F.col("baseline")) >= min_edge_pct) & (F.col("edge_score") != 0))
    named = far.withColumn("list", F.when(F.col("edge_score") > 0, "edges").otherwise("anti_patterns"))
    order = Window.partitionBy("list").orderBy(F.abs("edge_score").desc(), "event_type", *[F.coalesce(d, F.lit("")) for d in DIMENSIONS])
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def edges(events: DataFrame, least: int = 10) -> DataFrame:
    """Cells of one or two dimensions against their type's base rate. One pass of
    grouping sets: four singles and six pairs; an unknown value is no cell."""
    events = written_once(events.where("event_type <> 'session_range'"), "events")  # read for the cells and for their baselines
    base = baselines(events).select("event_type", "baseline")
    sets = [["event_type", *d] for k, d in enumerate([[a] for a in DIMENSIONS] + [[a, b] for i, a in enumerate(DIMENSIONS) for b in DIMENSIONS[i + 1 :]])]
    marks = [F.grouping(d).alias(f"g_{d}") for d in DIMENSIONS]
    cells = events.groupingSets(sets, "event_type", *DIMENSIONS).agg(F.count("*").alias("n"), rate(n_if(F.col("win")), F.count("*")).alias("win_rate"), *marks)
    known = F.lit(True)
    for d in DIMENSIONS:
        known = known & ((F.col(f"g_{d}") == 1) | F.col(d).isNotNull())
    filters = F.map_filter(F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), F.col(d))]), lambda k, v: v.isNotNull())
    out = cells.where(known & (F.col("n") >= least)).join(base, "event_type")
    return out.select("event_type", *DIMENSIONS, "n", "win_rate", "baseline", q((F.col("win_rate") - F.col("baseline")) * F.sqrt(F.col("n").cast("double")), 2).alias("edge_score"), filters.alias("filters"))
