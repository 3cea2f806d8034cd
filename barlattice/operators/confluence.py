"""Confluence: structure of two timeframes stacked into one score per symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written_all, written_once
from ..functions.scalars import over, q
from . import indicators as I
from . import profile as P
from . import structure as T

MIN_SCORE, COUNTER_MIN = 6, 8


def _cents(x) -> Column:
    return F.floor(F.col(x) * 100 + 0.5)


def grades(hourly: DataFrame, four_hourly: DataFrame, *, near: float = 0.5, cap: float = 2.0) -> DataFrame:
    """One row per symbol. Both inputs are indexed bars, cut to a few hundred a symbol.

    Every factor is an aggregate per symbol, joined to the symbol's row; there
    is no loop over symbols. Bars and structures, some hundred rows a symbol, are
    written once, since a dozen parts read them.
    """
    hourly, four_hourly = written_all(h1=hourly, h4=four_hourly)
    h1, h4 = T.of(hourly, short=True), T.of(four_hourly, short=True)
    now = hourly.groupBy("symbol").agg(F.max_by("close", "bar_idx").alias("price"), F.max("bar_ts").alias("as_of"), F.count("*").alias("n_bars"))
    known = written_once(T.structures(h1, 20, 5), "structures")
    t1 = T.trend(h1, 5, known).withColumnRenamed("trend_bias", "t1")
    t4 = T.trend(h4, 5).withColumnRenamed("trend_bias", "t4")
    span = T.trading_range(h1, 20, 5, known).select("symbol", "swing_high", "swing_low")
    base = now.join(t1, "symbol", "left").join(t4, "symbol", "left").join(span, "symbol", "left")
    one, four = F.coalesce("t1", F.lit(0)), F.coalesce("t4", F.lit(0))
    one_side = F.when(one == 1, 1).otherwise(-1)
    base = base.withColumns({"dir": F.when(four != 0, four).otherwise(one_side), "counter": (four != 0) & (one_side != four), "has4": four != 0, "aligned1": one_side})
    base, blocks, gaps, swept, equal = written_all(base=base, blocks=T.order_blocks(h1, 20, 5, known=known), gaps=T.gaps(h1), swept=T.liquidity_sweeps(h1, 5), equal=T.equal_levels(h1, 20))
    key = base.select("symbol", "price", "dir", "n_bars", "swing_high", "swing_low")

    def off(x: Column) -> Column:
        return F.abs(F.col("price") - x) / F.col("price") * 100

    mid = (F.col("ob_high") + F.col("ob_low")) / 2
    matched = blocks.join(key, "symbol").where((off(mid) < near) & (F.col("bias") == F.col("dir")))
    ob = matched.groupBy("symbol").agg(F.min_by(F.struct("ob_high", "ob_low"), "ord").alias("ob"))
    gaps = gaps.withColumn("mid", (F.col("top") + F.col("bottom")) / 2)
    gap = gaps.join(key, "symbol").where((off(F.col("mid")) < near) & (F.col("bias") == F.col("dir"))).groupBy("symbol").agg(F.lit(True).alias("has_gap"))
    recent = swept.join(key, "symbol").where((F.col("bias") == F.col("dir")) & (F.col("bar_index") >= F.col("n_bars") - 30))
    sweep = recent.groupBy("symbol").agg(F.max_by(F.struct("level", "bar_index"), F.struct("bar_index", "pivot_index")).alias("sweep"))
    after = known.join(sweep, "symbol").join(key.select("symbol", "dir"), "symbol").where("end_index > sweep.bar_index and bias = dir").groupBy("symbol").agg(F.min_by("type", "ord").alias("after_sweep"))
    pools = equal.select("symbol", "level", "type", "ord").unionByName(
        base.where("swing_high is not null").select("symbol", F.explode(F.array(F.struct(F.col("swing_high").alias("level"), F.lit("Swing High").alias("type"), F.lit(1_000_000).alias("ord")), F.struct(F.col("swing_low").alias("level"), F.lit("Swing Low").alias("type"), F.lit(1_000_001).alias("ord")))).alias("x")).select("symbol", "x.*")
    )
    unswept = pools.withColumn("cents", _cents("level")).join(swept.select("symbol", _cents("level").alias("cents")).distinct(), ["symbol", "cents"], "left_anti")
    ahead = unswept.join(key, "symbol").where((F.col("level") - F.col("price")) * F.col("dir") > 0)
    draw = ahead.groupBy("symbol").agg(F.min_by(F.struct("level", "type"), F.struct((F.col("level") - F.col("price")) * F.col("dir"), "ord")).alias("draw"))
    latest = P.recent_sessions(hourly, "1h", 1)
    levels = P.profiles(latest, ["symbol"]).select("symbol", "poc", "vah", "val").join(now.where("n_bars >= 20").select("symbol"), "symbol")
    opposite = blocks.join(key, "symbol").where(F.col("bias") == -F.col("dir")).select("symbol", F.when(F.col("dir") == 1, F.col("ob_low")).otherwise(F.col("ob_high")).alias("x"), "price", "dir")
    edges = gaps.join(key, "symbol").where((F.col("mid") - F.col("price")) * F.col("dir") > 0).select("symbol", F.when(F.col("dir") == 1, F.col("bottom")).otherwise(F.col("top")).alias("x"), "price", "dir")
    swings = key.select("symbol", F.when(F.col("dir") == 1, F.col("swing_high")).otherwise(F.col("swing_low")).alias("x"), "price", "dir")
    evens = equal.join(key, "symbol").select("symbol", F.col("level").alias("x"), "price", "dir")
    own_side = (F.col("x") - F.col("price")) * F.col("dir") > 0
    goals = reduce(DataFrame.unionByName, [opposite.where(own_side), edges, swings.where(own_side), evens.where(own_side)])
    # a gap's near edge may lie behind price while its middle lies ahead
    size = F.abs(F.col("x") - F.col("price"))
    goal = goals.where((size > 0) & (size <= F.col("price") * cap / 100)).groupBy("symbol").agg(F.max(F.when(F.col("dir") == -1, F.col("x"))).alias("g_low"), F.min(F.when(F.col("dir") == 1, F.col("x"))).alias("g_high"))
    atr = I.atr(hourly, 14).groupBy("symbol").agg(F.max_by("atr", "bar_idx").alias("atr"))
    j = base
    for part in (ob, gap, sweep, after, draw, levels, goal, atr):
        j = j.join(part, "symbol", "left")
    has_ob = F.col("ob").isNotNull()
    ob_mid = (F.col("ob.ob_high") + F.col("ob.ob_low")) / 2
    reach = F.col("swing_high") - F.col("swing_low")
    lo, hi = F.when(F.col("dir") == 1, F.col("swing_high") - 0.786 * reach).otherwise(F.col("swing_low") + 0.618 * reach), F.when(F.col("dir") == 1, F.col("swing_high") - 0.618 * reach).otherwise(F.col("swing_low") + 0.786 * reach)
    ote = F.coalesce((reach > 0) & (lo <= ob_mid) & (ob_mid <= hi), F.lit(False))
    has_draw = F.coalesce(off(F.col("draw.level")) < 5, F.lit(False))
    place = F.when(reach > 0, (F.col("price") - F.col("swing_low")) / reach * 100)
    deep = F.coalesce(F.when(F.col("dir") == 1, place < 20).otherwise(place > 80), F.lit(False))
    slack = F.greatest(F.col("ob.ob_high") - F.col("ob.ob_low"), F.col("price") * 0.003)
    tpo = F.coalesce(F.abs(ob_mid - F.col("poc")) <= slack, F.lit(False)) | F.coalesce(F.abs(ob_mid - F.col("vah")) <= slack, F.lit(False)) | F.coalesce(F.abs(ob_mid - F.col("val")) <= slack, F.lit(False))
    points = [("4H bias", F.col("has4"), 1), ("OB", F.lit(True), 2), ("FVG", F.coalesce("has_gap", F.lit(False)), 1), ("OTE", ote, 1), ("sweep", F.col("sweep").isNotNull(), 2), ("draw", has_draw, 1), ("deep zone", deep, 1), ("no macro", F.lit(True), 1), ("TPO", tpo, 2)]
    total = sum((F.when(c, p).otherwise(0) for _, c, p in points), F.lit(0))
    score = F.when(has_ob, total).otherwise(0)
    named = F.when(has_ob, F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c, _ in points])).otherwise("")
    long = F.col("dir") == 1
    target = F.when(long, F.coalesce("g_high", F.col("price") * (1 + cap / 100))).otherwise(F.coalesce("g_low", F.col("price") * (1 - cap / 100)))
    stop_off = F.when(F.col("atr") > 0, F.col("atr") * 1.5).otherwise(F.col("price") * 0.01)
    return j.select(
        "symbol", "as_of", "price", score.alias("score"), F.when(long, "long").otherwise("short").alias("direction"), F.col("counter").alias("is_counter_trend"),
        ((score >= MIN_SCORE) & ~(F.col("counter") & (score < COUNTER_MIN))).alias("meets_threshold"), named.alias("factors"), F.when(has_ob, F.col("after_sweep")).alias("after_sweep"), q(target).alias("target"), q(F.when(long, F.col("price") - stop_off).otherwise(F.col("price") + stop_off)).alias("invalidation"),
    )


def ranked(graded: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rank by score, threshold, trend; then by the watchlist's order or name."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("symbol")) if order else F.col("symbol")
    from pyspark.sql import Window

    w = Window.orderBy(F.col("score").desc(), F.col("meets_threshold").desc(), F.col("is_counter_trend"), place)
    return graded.withColumn("rank", F.row_number().over(w))
