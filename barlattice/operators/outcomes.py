"""What came after structures: forward tests in sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import n_if, q, rate, smc_session
from ..functions.lineage import written_once
from . import structure as T

WINDOW, STEP = 200, 50
#: Bars looked ahead, and the move in percent that counts.
AHEAD = {"ob": 24, "fvg": 48, "bos": 8, "choch": 12, "eq": 6, "sweep": 12}
MOVE = {"bos": 0.3, "choch": 0.5, "eq": 0.3, "sweep": 1.0}


def windows(bars: DataFrame, since: DataFrame | None = None) -> T.Series:
    """Indexed bars dealt to overlapping windows: every ``STEP`` bars a window of
    ``WINDOW`` begins, as long as a bar follows it. A bar stands in at most
    WINDOW / STEP windows, and (symbol, win) spreads a single symbol's history.
    ``since`` has the ``open_win`` of symbols whose earlier windows are left out."""
    sizes = bars.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("held"))
    sizes = sizes.withColumn("open_win", F.lit(0)) if since is None else sizes.join(since, "symbol", "left")
    n = F.col("held")
    first = F.ceil(F.greatest(F.col("bar_idx") - (WINDOW - 1), F.coalesce("open_win", F.lit(0))) / STEP).cast("int")
    last = F.least(F.floor(F.col("bar_idx") / STEP), F.floor((n - WINDOW - 1) / STEP)).cast("int")
    dealt = bars.join(sizes, "symbol").withColumns({"first": first, "last": last}).drop("held", "open_win").where("last >= first").withColumn("win", F.explode(F.sequence("first", "last")))
    return T.Series(dealt.withColumn("win", F.col("win") * STEP).withColumn("i", F.col("bar_idx") - F.col("win")).drop("first", "last"), ("symbol", "win"), short=True)


def found(s: T.Series, swing: int = 20, internal: int = 5, known: DataFrame | None = None) -> DataFrame:
    """Structures of every kind in every window, once each by kind and bar: the
    first window, and its first in list order, wins. ``known``: the breaks of the
    windows, if they are at hand."""
    known = T.structures(s, swing, internal) if known is None else known
    none = F.lit(None)

    def rows(df: DataFrame, kind: Column, at: str, ord_: Column, bias: Column, level: Column = none, top: Column = none, bottom: Column = none) -> DataFrame:
        return df.select("symbol", "win", kind.alias("kind"), (F.col("win") + F.col(at)).alias("idx"), ord_.alias("ord"), bias.alias("bias"), level.cast("double").alias("level"), top.cast("double").alias("top"), bottom.cast("double").alias("bottom"))

    bias = F.col("bias")
    ob = rows(T.order_blocks(s, swing, internal, known=known), F.lit("ob"), "bar_index", F.col("ord"), bias, none, F.col("ob_high"), F.col("ob_low"))
    gap = rows(T.gaps(s), F.lit("fvg"), "bar_index", F.when(bias == 1, 0).otherwise(1), bias, none, F.col("top"), F.col("bottom"))
    brk = rows(known, F.lower("type"), "end_index", F.col("ord"), bias, F.col("level"))
    eq = rows(T.equal_levels(s, swing), F.lit("eq"), "curr_index", F.col("ord"), F.when(F.col("type") == "EQH", -1).otherwise(1), F.col("level"))
    sw = rows(T.liquidity_sweeps(s, internal), F.lit("sweep"), "bar_index", F.col("pivot_index") + F.when(bias == -1, 0).otherwise(1_000_000), bias, F.col("level"))
    every = ob.unionByName(gap).unionByName(brk).unionByName(eq).unionByName(sw)
    first = F.row_number().over(Window.partitionBy("symbol", "kind", "idx").orderBy("win", "ord"))
    return every.withColumn("nth", first).where("nth = 1").drop("nth")


def evaluated(bars: DataFrame, swing: int = 20, internal: int = 5, since: DataFrame | None = None) -> DataFrame:
    """One row per structure with its outcome flags; those without a later bar go.
    With ``since`` (:func:`windows`) only the windows from there on are evaluated."""
    bars = written_once(bars, "bars")
    s = windows(bars, since)
    known = written_once(T.structures(s, swing, internal), "structures")
    f = written_once(found(s, swing, internal, known), "found")
    trend = T.trend(s, internal, known)
    # only bars with a structure look ahead
    at = f.select("symbol", "idx").distinct()
    met = T.bars_between(at, bars.select("symbol", F.col("bar_idx").alias("i"), "high", "low", "close"), ("symbol",), F.col("idx") + 1, F.col("idx") + max(AHEAD.values()))
    ahead = met.groupBy("symbol", "idx").agg(F.array_sort(F.collect_list(F.struct("i", "high", "low", "close"))).alias("after"))
    times = bars.select("symbol", F.col("bar_idx").alias("idx"), "bar_ts")
    # a window sees no further than 48 bars beyond its end
    j = f.join(ahead, ["symbol", "idx"]).join(times, ["symbol", "idx"]).join(trend, ["symbol", "win"], "left")
    length = F.create_map(*[F.lit(x) for kv in AHEAD.items() for x in kv])[F.col("kind")]
    seen = F.filter("after", lambda a: (a["i"] < F.col("win") + WINDOW + 48) & (a["i"] <= F.col("idx") + F.col("length")))
    j = j.withColumn("length", length).withColumn("seen", seen).where("size(seen) > 0")
    bull = F.col("bias") == 1
    # order blocks: three bars away, then a return
    away = lambda a: F.when(bull, a["low"] > F.col("top")).otherwise(a["high"] < F.col("bottom"))
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(False).alias("held"), F.lit(0).alias("pos"))

    def step(st, a):
        n = st["n"] + F.when(away(a), 1).otherwise(0)
        touch = (n >= 3) & F.when(bull, a["low"] <= F.col("top")).otherwise(a["high"] >= F.col("bottom"))
        held = F.when(bull, a["close"] >= F.col("bottom")).otherwise(a["close"] <= F.col("top"))
        return F.when(st["at"] > 0, st).otherwise(F.struct(n.alias("n"), F.when(touch, st["pos"] + 1).otherwise(0).alias("at"), (touch & held).alias("held"), (st["pos"] + 1).alias("pos")))

    ob = F.when(F.col("kind") == "ob", F.aggregate("seen", state, step))
    # gaps: the first three bars do not count
    late = F.filter("seen", lambda a: a["i"] > F.col("idx") + 3)
    into = lambda a: F.when(bull, F.col("top") - F.greatest(a["low"], F.col("bottom"))).otherwise(F.least(a["high"], F.col("top")) - F.col("bottom"))
    filled = F.filter(late, lambda a: F.when(bull, a["low"] <= F.col("top")).otherwise(a["high"] >= F.col("bottom")))
    most_filled = F.coalesce(F.array_max(F.transform(filled, into)), F.lit(0.0))
    # levels: the farthest move beyond
    move = lambda x: F.abs(x - F.col("level")) / F.col("level") * 100
    beyond = lambda a, up: F.when(up & (a["high"] > F.col("level")), move(a["high"])).when(~up & (a["low"] < F.col("level")), move(a["low"])).otherwise(0.0)
    swept_at = F.array_min(F.transform(F.filter("seen", lambda a: F.when(bull, a["low"] < F.col("level")).otherwise(a["high"] > F.col("level"))), lambda a: a["i"]))
    from_sweep = F.filter("seen", lambda a: a["i"] >= swept_at)
    farthest = F.when(F.col("kind") == "eq", F.coalesce(F.array_max(F.transform(from_sweep, lambda a: beyond(a, bull))), F.lit(0.0))).otherwise(F.array_max(F.transform("seen", lambda a: beyond(a, bull))))
    is_level = F.col("kind").isin("bos", "choch", "eq", "sweep")
    need = F.create_map(*[F.lit(x) for kv in MOVE.items() for x in kv])[F.col("kind")]
    j = j.withColumns({"ob": ob, "far": F.when(is_level, farthest), "fill": F.when(F.col("kind") == "fvg", most_filled), "fill_at": F.when(F.col("kind") == "fvg", F.array_min(F.transform(filled, lambda a: a["i"])))})
    return j.select(
        "symbol", "kind", "idx", "bar_ts", "win", "bias", "level", "top", "bottom",
        F.when(F.col("kind") == "ob", F.col("ob.at") > 0).alias("retested"), F.when(F.col("kind") == "ob", F.col("ob.at")).alias("retested_within"), F.when(F.col("kind") == "ob", F.col("ob.held")).alias("held"),
        F.when(F.col("kind") == "fvg", F.col("fill_at").isNotNull()).alias("filled"), F.when(F.col("kind") == "fvg", F.coalesce(F.col("fill_at") - F.col("idx"), F.lit(0)).cast("int")).alias("filled_within"),
        F.when(F.col("kind") == "fvg", q(F.coalesce(F.try_divide(F.col("fill"), F.col("top") - F.col("bottom")) * 100, F.lit(0.0)), 2)).alias("filled_pct"),
        F.when(F.col("kind") == "eq", swept_at.isNotNull()).alias("swept"), q("far", 4).alias("max_move_pct"), F.when(is_level, F.col("far") >= need).alias("success"),
        smc_session(F.hour("bar_ts")).alias("session"),
        F.when(~F.col("kind").isin("eq", "sweep"), F.when(F.coalesce("trend_bias", F.lit(0)) == 1, "bullish").otherwise("bearish")).alias("trend_at_formation"),
    )


def open_windows(seen: DataFrame) -> DataFrame:
    """``symbol, open_win``: the first window that could still change when bars follow
    the first ``seen`` bars of a symbol. A window sees WINDOW + 48 bars."""
    return seen.select("symbol", (F.ceil(F.greatest(F.col("seen") - (WINDOW + 48 - 1), F.lit(0)) / STEP) * STEP).cast("int").alias("open_win"))


def extended(stored: DataFrame, bars: DataFrame, seen: DataFrame, swing: int = 20, internal: int = 5) -> DataFrame:
    """What :func:`evaluated` gives for ``bars``, from what it gave (``stored``) for the
    first ``seen(symbol, seen)`` of them: outcomes of windows that can change no more
    stay, and of the bars only those from the first open window on are read."""
    open_ = written_once(open_windows(seen), "open")
    tail = bars.join(open_, "symbol", "left").where(F.col("bar_idx") >= F.coalesce("open_win", F.lit(0))).drop("open_win")
    settled = stored.join(open_, "symbol").where(F.col("win") < F.col("open_win")).drop("open_win")
    new = evaluated(tail, swing, internal, open_)
    return settled.unionByName(new.join(settled.select("symbol", "kind", "idx"), ["symbol", "kind", "idx"], "left_anti"))


def summary(events: DataFrame, *by: str) -> DataFrame:
    """Counts and rates per kind, each with the figures that it has."""
    n = F.count("*")
    won = F.when(F.col("kind") == "ob", F.col("held")).when(F.col("kind") == "fvg", F.col("filled")).otherwise(F.col("success"))
    return events.groupBy("kind", *by).agg(
        n.alias("n"), rate(n_if(won), n).alias("success_pct"), rate(n_if(F.col("retested")), n).alias("retested_pct"), rate(n_if(F.col("held")), n_if(F.col("retested"))).alias("held_pct"),
        rate(n_if(F.col("swept")), n).alias("swept_pct"), q(F.avg("max_move_pct"), 3).alias("avg_move_pct"), q(F.avg(F.when(F.col("filled"), F.col("filled_within"))), 3).alias("avg_bars_to_fill"),
    )


def statistics(events: DataFrame, *by: str) -> DataFrame:
    """The six aggregates, a row per kind: its own rates and means, null for what
    the kind doesn't have, and its sides."""
    n, kind = F.count("*"), F.col("kind")
    is_ = lambda *x: kind.isin(*x)
    mean = lambda c, places: F.coalesce(F.floor(F.avg(F.floor(c.cast("double") * 1e6 + 0.5)) / 10.0 ** (6 - places) + 0.5) / 10.0**places, F.lit(0.0))
    some = lambda c: n_if(F.col(c))
    bull, bear = n_if(F.col("bias") == 1), n_if(F.col("bias") == -1)
    sided = is_("ob", "fvg", "bos", "choch")
    figures = {
        "retest_rate": F.when(is_("ob"), rate(some("retested"), n)), "hold_rate": F.when(is_("ob"), rate(some("held"), n)), "hold_rate_when_retested": F.when(is_("ob"), rate(some("held"), some("retested"))),
        "avg_retest_candles": F.when(is_("ob"), mean(F.when(F.col("retested"), F.col("retested_within")), 1)),
        "fill_rate": F.when(is_("fvg"), rate(some("filled"), n)), "avg_fill_candles": F.when(is_("fvg"), mean(F.when(F.col("filled"), F.col("filled_within")), 1)), "avg_fill_pct": F.when(is_("fvg"), mean(F.col("filled_pct"), 1)),
        "continuation_rate": F.when(is_("bos"), rate(some("success"), n)), "reversal_rate": F.when(is_("choch", "eq"), rate(some("success"), n)), "sweep_rate": F.when(is_("eq"), rate(some("swept"), n)),
        "reversal_rate_when_swept": F.when(is_("eq"), rate(some("success"), some("swept"))), "avg_reversal_pct": F.when(is_("eq"), mean(F.col("max_move_pct"), 4)), "success_rate": F.when(is_("sweep"), rate(some("success"), n)),
        "avg_max_move_pct": F.when(is_("bos", "choch", "sweep"), mean(F.col("max_move_pct"), 4)), "bullish": F.when(sided, bull), "bearish": F.when(sided, bear), "eqh": F.when(is_("eq"), bear), "eql": F.when(is_("eq"), bull),
        "wick": F.when(is_("sweep"), n), "retest": F.when(is_("sweep"), F.lit(0).cast("long")),
    }
    return events.groupBy("kind", *by).agg(n.alias("n"), *[c.alias(k) for k, c in figures.items()])
