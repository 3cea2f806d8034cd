"""Market structure: pivots, breaks, gaps, order blocks, sweeps.

Detectors take bars with the columns of ``by`` and ``i`` (the bar's place in its
series) and never loop: what looks sequential is a window, a conditional
minimum or a last value carried forward. A window that looks a bounded number of
bars back or ahead runs by blocks of bars with a halo, and what is carried over a
whole history goes from block to block (:mod:`scan`), so that one series spreads
over tasks. Tests of "exists later" are suffix scans, joins by blocks of bars
(:func:`bars_between`), or ask the blocks' extremes first (:func:`first_beyond`);
their work grows with the history and not with its square.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.lineage import written_once
from . import scan as K

BULL, BEAR = 1, -1
#: Pivot lengths (swing, internal) of a timeframe.
LENGTHS = {"1m": (50, 5), "5m": (50, 5), "15m": (20, 5), "1h": (20, 5), "4h": (10, 5), "1d": (10, 5), "1w": (10, 5)}


@dataclass(frozen=True)
class Series:
    """Bars with the columns that identify a series; ``short`` ones have a bound
    and are one window each; ``kept`` ones are read from files."""

    bars: DataFrame
    by: tuple[str, ...] = ("symbol",)
    short: bool = False
    kept: bool = False

    def w(self, *order):
        return Window.partitionBy(*self.by).orderBy(*(order or ("i",)))

    def near(self, before: int = 0, after: int = 0) -> tuple[DataFrame, WindowSpec]:
        """The bars and a window in whose frames each bar sees so many others; only
        the bars with ``halo_own`` are to stay."""
        if self.short:
            return self.bars.withColumn("halo_own", F.lit(True)), self.w()
        return K.halo(self.bars, before, after, "i"), K.over_halo(list(self.by), "i")

    def block(self, index: str = "i", width: int = K.WIDTH) -> Column | None:
        return None if self.short else K.width_of(index, width)

    def once(self, df: DataFrame, tag: str) -> DataFrame:
        """What a scan reads twice, from files where a series is long."""
        return df if self.short else written_once(df, tag)

    def keep(self) -> Series:
        """The same series for an operator that reads its bars many times."""
        return self if self.short or self.kept else Series(written_once(self.bars, "bars"), self.by, kept=True)


def bars_between(rows: DataFrame, bars: DataFrame, by: tuple[str, ...], start: Column, stop: Column, width: int = 256) -> DataFrame:
    """``rows`` joined to the ``bars`` with ``start <= i <= stop``: by the series
    and each block of ``width`` bars that the span touches."""
    blocks = F.sequence(F.floor(start / width).cast("int"), F.floor(stop / width).cast("int"))
    dealt = rows.withColumns({"span_start": start, "span_stop": stop}).where("span_stop >= span_start").withColumn("span_block", F.explode(blocks))
    placed = bars.withColumn("span_block", F.floor(F.col("i") / width).cast("int"))
    met = dealt.join(placed, [*by, "span_block"])
    return met.where((F.col("i") >= F.col("span_start")) & (F.col("i") <= F.col("span_stop"))).drop("span_start", "span_stop", "span_block")


def first_beyond(rows: DataFrame, s: Series, keys: list[str], start: Column, stop: Column, width: int = 128) -> DataFrame:
    """``rows`` (``side`` high or low, ``price``; one row for each of ``keys``) with ``x``, the
    first bar from ``start`` to ``stop`` that goes beyond the price and does not
    close on it; rows without one go.

    Blocks of bars are asked first: only one whose extreme lies beyond the price
    can hold the bar. The first two of those are joined; where every bar beyond in
    them lies outside the span or closes on the price, the row meets the others.
    """
    rows = rows.withColumns({"span_start": start, "span_stop": stop}).where("span_stop >= span_start")
    bars = s.bars.select(*s.by, "i", "bar_ts", "high", "low", "close").withColumn("span_block", F.floor(F.col("i") / width).cast("int"))
    high = F.col("side") == "high"
    beyond = F.when(high, F.col("high") > F.col("price")).otherwise(F.col("low") < F.col("price")) & (F.col("close") != F.col("price")) & F.col("i").between(F.col("span_start"), F.col("span_stop"))
    bar = F.struct("i", "bar_ts", "high", "low", "close")
    id_ = [*s.by, *keys]
    if s.short:
        met = bars_between(rows.withColumns({"from": F.col("span_start"), "to": F.col("span_stop")}), bars.drop("span_block"), s.by, F.col("from"), F.col("to"))
        return met.withColumns({"span_start": F.col("from"), "span_stop": F.col("to")}).where(beyond).groupBy(*id_).agg(F.min_by(bar, "i").alias("x"))
    summaries = bars.groupBy(*s.by, "span_block").agg(F.max("high").alias("top"), F.min("low").alias("bottom"))
    asked = rows.withColumn("span_block", F.explode(F.sequence(F.floor(F.col("span_start") / width).cast("int"), F.floor(F.col("span_stop") / width).cast("int"))))
    may = asked.join(summaries, [*s.by, "span_block"]).where(F.when(high, F.col("top") > F.col("price")).otherwise(F.col("bottom") < F.col("price")))
    order = F.row_number().over(Window.partitionBy(*id_).orderBy("span_block"))
    ranked = may.withColumn("turn", order).select(*id_, "span_start", "span_stop", "span_block", "turn")
    found = ranked.where("turn <= 2").join(bars, [*s.by, "span_block"]).where(beyond).groupBy(*id_).agg(F.min_by(bar, "i").alias("x"))
    rest = ranked.where("turn > 2").join(found, id_, "left_anti").join(bars, [*s.by, "span_block"]).where(beyond).groupBy(*id_).agg(F.min_by(bar, "i").alias("x"))
    return found.unionByName(rest)


def enough(bars: DataFrame, least: int, by: tuple[str, ...] = ("symbol",), what: str | None = None) -> DataFrame:
    """The rows of the series that have ``least`` rows, or distinct values of
    ``what``, at least; the others go whole."""
    n = F.count_distinct(what) if what else F.count("*")
    wide = bars.groupBy(*by).agg(n.alias("enough_n")).where(F.col("enough_n") >= least).select(*by)
    return bars.join(wide, list(by), "left_semi")


def long_enough(bars: DataFrame, swing: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The series in which a swing pivot can stand: of ``2 * swing + 1`` bars or more."""
    return enough(bars, 2 * swing + 1, by)


def of(bars: DataFrame, by: tuple[str, ...] = ("symbol",), short: bool = False) -> Series:
    """A series from indexed bars; ``short`` if each was cut to a few hundred of them."""
    return Series(bars.withColumnRenamed("bar_idx", "i"), by, short)


def pivots(s: Series, k: int) -> DataFrame:
    """``side, i, price, bar_ts``: extremes of the ``k`` bars on either side;
    equals are allowed on the left only."""
    bars, w = s.near(k, k)
    left, right = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
    high = (F.max("high").over(left) <= F.col("high")) & (F.max("high").over(right) < F.col("high"))
    low = (F.min("low").over(left) >= F.col("low")) & (F.min("low").over(right) > F.col("low"))
    full = (F.count("*").over(left) == k) & (F.count("*").over(right) == k)
    cells = F.array_compact(
        F.array(
            F.when(full & high, F.struct(F.lit("high").alias("side"), F.col("high").alias("price"))),
            F.when(full & low, F.struct(F.lit("low").alias("side"), F.col("low").alias("price"))),
        )
    )
    return bars.withColumn("cells", cells).where("halo_own").select(*s.by, "i", "bar_ts", F.explode("cells").alias("x")).select(*s.by, "i", "bar_ts", "x.side", "x.price")


def _crossings(s: Series, k: int, ahead: int) -> DataFrame:
    """Breaks of the standing pivots, in the order in which pivots reveal them.

    At each pivot the newest high and low stand; the first close beyond one
    within ``ahead`` bars crosses it, once. ``seq`` orders pivots: two places for
    each bar, its high and its low.
    """
    high = F.col("side") == "high"
    p = s.once(pivots(s, k).withColumn("seq", F.col("i") * 2 + F.when(high, 0).otherwise(1)), "pivots")
    own = F.struct("seq", "i", "price", "bar_ts")
    e = K.carried(p, list(s.by), [F.col("seq")], s.block(), {"up": F.when(high, own), "down": F.when(~high, own)})
    closes = s.bars.select(*s.by, "i", "close")
    near = bars_between(e.drop("side", "price", "bar_ts").withColumnRenamed("i", "at"), closes, s.by, F.col("at") + 1, F.col("at") + ahead)
    x = near.groupBy(*s.by, "seq").agg(
        F.first("up").alias("up"), F.first("down").alias("down"),
        F.min(F.when(F.col("close") > F.col("up.price"), F.col("i"))).alias("up_x"), F.min(F.when(F.col("close") < F.col("down.price"), F.col("i"))).alias("down_x"),
    )
    sides = F.array_compact(
        F.array(
            F.when(F.col("up_x").isNotNull(), F.struct(F.lit(BULL).alias("bias"), F.col("up").alias("pivot"), F.col("up_x").alias("end_index"))),
            F.when(F.col("down_x").isNotNull(), F.struct(F.lit(BEAR).alias("bias"), F.col("down").alias("pivot"), F.col("down_x").alias("end_index"))),
        )
    )
    out = x.select(*s.by, "seq", F.explode(sides).alias("x")).select(*s.by, "seq", "x.bias", "x.pivot", "x.end_index")
    once = out.groupBy(*s.by, "bias", F.col("pivot.seq").alias("pivot_seq")).agg(F.min_by(F.struct("seq", "pivot", "end_index"), "seq").alias("x"))
    return s.once(once.select(*s.by, "x.seq", "bias", "x.pivot", "x.end_index"), "crossings")


def _listed(s: Series, crossings: DataFrame) -> DataFrame:
    """Crossings with their place in list order, ``ord`` from 0, and the bias
    ``before`` each."""
    order = [F.col("seq"), F.when(F.col("bias") == BULL, 0).otherwise(1)]
    totals = {"scan_n": (F.count("*"), lambda c, w: F.sum(c).over(w)), "scan_bias": (F.max_by("bias", F.struct(*order)), lambda c, w: F.last(c).over(w))}
    w = K.inside(list(s.by), *order)
    placed = K.with_entries(crossings, list(s.by), s.block("seq", 2 * K.WIDTH), totals)
    ord_, before = F.row_number().over(w) - 1 + F.coalesce("scan_n", F.lit(0)), F.coalesce(F.lag("bias").over(w), "scan_bias")
    return placed.withColumns({"ord": ord_.cast("int"), "before": before}).drop("scan_n", "scan_bias", "scan_block")


def breaks(s: Series, k: int, ahead: int = 49) -> DataFrame:
    """``ord, type, bias, level, start_index, end_index``: BOS, or CHoCH where the
    bias turns."""
    c = _listed(s, _crossings(s, k, ahead))
    turned = F.col("before") == -F.col("bias")
    return c.withColumns({"ord": F.col("ord") + 1, "type": F.when(turned, "CHoCH").otherwise("BOS")}).select(
        *s.by, "ord", "type", "bias", F.col("pivot.price").alias("level"), F.col("pivot.i").alias("start_index"), "end_index"
    )


def structures(s: Series, swing: int, internal: int) -> DataFrame:
    """Breaks of both passes as one list: ``pass`` 0 swing, 1 internal; ``ord`` goes on."""
    s = s.keep()
    first, second = breaks(s, swing).withColumn("pass", F.lit(0)), breaks(s, internal).withColumn("pass", F.lit(1))
    n = first.groupBy(*s.by).agg(F.max("ord").alias("n"))
    later = second.join(n, list(s.by), "left").withColumn("ord", F.col("ord") + F.coalesce("n", F.lit(0))).drop("n")
    return first.unionByName(later)


def trend(s: Series, internal: int, known: DataFrame | None = None) -> DataFrame:
    """``trend_bias`` per series: the last break's; series without breaks have no
    row. ``known``: the series' structures, if they are at hand."""
    own = breaks(s, internal) if known is None else known.where(F.col("pass") == 1)
    return own.groupBy(*s.by).agg(F.max_by("bias", "ord").alias("trend_bias"))


def newest(df: DataFrame, s: Series, order: list, n: int) -> DataFrame:
    """The last ``n`` of each series in list order."""
    back = [F.col(o).desc() if isinstance(o, str) else o.desc() for o in order]
    rank = F.row_number().over(Window.partitionBy(*s.by).orderBy(*back))
    return df.withColumn("nth", rank).where(F.col("nth") <= n).drop("nth")


def later_extremes(s: Series) -> DataFrame:
    """The bars with the lowest low and highest high of all bars after each: in its
    block, and of the blocks that follow."""
    w = Window.partitionBy(*s.by, "scan_block").orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    totals = {"scan_low": (F.min("low"), lambda c, v: F.min(c).over(v)), "scan_high": (F.max("high"), lambda c, v: F.max(c).over(v))}
    out = K.with_entries(s.bars, list(s.by), s.block(), totals, back=True)
    return out.withColumns({"later_low": F.least(F.min("low").over(w), "scan_low"), "later_high": F.greatest(F.max("high").over(w), "scan_high")}).drop("scan_block", "scan_low", "scan_high")


def gaps(s: Series, keep: int | None = 20) -> DataFrame:
    """Fair value gaps that later bars have not closed, the last ``keep``."""
    later = later_extremes(s)
    bars, w = Series(later, s.by, s.short).near(before=2)
    before = lambda c: F.lag(c, 2).over(w)
    up, down = F.col("low") > before("high"), F.col("high") < before("low")
    later_low, later_high = F.col("later_low"), F.col("later_high")
    cells = F.array_compact(
        F.array(
            F.when(up, F.struct(F.lit(BULL).alias("bias"), F.col("low").alias("top"), before("high").alias("bottom"), F.coalesce(later_low < before("high"), F.lit(False)).alias("mitigated"))),
            F.when(down, F.struct(F.lit(BEAR).alias("bias"), before("low").alias("top"), F.col("high").alias("bottom"), F.coalesce(later_high > before("low"), F.lit(False)).alias("mitigated"))),
        )
    )
    found = bars.withColumns({"cells": cells, "mid_ts": F.lag("bar_ts").over(w)}).where("halo_own").select(*s.by, (F.col("i") - 1).alias("bar_index"), "mid_ts", F.explode("cells").alias("x"))
    out = found.select(*s.by, "bar_index", F.col("mid_ts").alias("bar_ts"), "x.*").where("not mitigated").drop("mitigated")
    return out if keep is None else newest(out, s, ["bar_index", F.when(F.col("bias") == BULL, 0).otherwise(1)], keep)


def _origins(s: Series, found: DataFrame, side_of_bull: str) -> DataFrame:
    """Breaks with the extreme bar (``ob_*``) of the 10 bars before their pivot
    and the pivot itself. ``side_of_bull``: the extreme taken for bullish breaks."""
    bars, near = s.near(before=10)
    w = near.rowsBetween(-10, 0)
    lowest, highest = F.min(F.struct("low", "i", "high", "bar_ts")).over(w), F.min(F.struct((-F.col("high")).alias("neg"), "i", "high", "low", "bar_ts")).over(w)
    marks = bars.select(*s.by, F.col("i").alias("start_index"), lowest.alias("lowest"), highest.alias("highest"), "halo_own").where("halo_own").drop("halo_own")
    use_low = (F.col("bias") == BULL) if side_of_bull == "low" else (F.col("bias") == BEAR)
    j = found.join(marks, [*s.by, "start_index"])
    pick = lambda c: F.when(use_low, F.col(f"lowest.{c}")).otherwise(F.col(f"highest.{c}"))
    return j.withColumns({"ob_index": pick("i"), "ob_high": pick("high"), "ob_low": pick("low"), "ob_ts": pick("bar_ts")}).drop("lowest", "highest")


def order_blocks(s: Series, swing: int, internal: int, keep: int = 10, known: DataFrame | None = None) -> DataFrame:
    """Extreme bars before the last ``2 * keep`` breaks that no later bar has
    passed. ``known``: the series' structures, if they are at hand."""
    s = s.keep()
    recent = newest(structures(s, swing, internal) if known is None else known, s, ["ord"], 2 * keep)
    later = later_extremes(s).select(*s.by, F.col("i").alias("ob_index"), "later_low", "later_high")
    o = _origins(s, recent, "low").join(later, [*s.by, "ob_index"])
    passed = F.when(F.col("bias") == BULL, F.col("later_low") < F.col("ob_low")).otherwise(F.col("later_high") > F.col("ob_high"))
    open_ = o.where(~F.coalesce(passed, F.lit(False)))
    return newest(open_, s, ["ord"], keep).select(*s.by, "ord", F.col("ob_index").alias("bar_index"), F.col("ob_ts").alias("bar_ts"), "ob_high", "ob_low", "bias")


def equal_levels(s: Series, swing: int, share: float = 0.003) -> DataFrame:
    """Pairs of like pivots 1, 2 or 3 apart with nearly one price, in list order."""
    p = pivots(s, swing)
    w = Window.partitionBy(*s.by, "side").orderBy("i")
    back = [F.struct(F.lit(d).alias("d"), F.lag("i", d).over(w).alias("prev_index"), F.lag("price", d).over(w).alias("prev_price"), F.lag("bar_ts", d).over(w).alias("prev_ts")) for d in (1, 2, 3)]
    pairs = p.withColumn("back", F.array(*back)).select(*s.by, "side", "i", "price", "bar_ts", F.explode("back").alias("b")).where("b.prev_index is not null")
    mean = (F.col("price") + F.col("b.prev_price")) / 2
    near = pairs.where((mean > 0) & (F.abs(F.col("price") - F.col("b.prev_price")) / mean < share))
    order = [F.when(F.col("side") == "high", 0).otherwise(1), F.when(F.col("b.d") == 1, 0).otherwise(1), F.col("i"), -F.col("b.d")]
    return near.withColumn("ord", F.row_number().over(s.w(*order))).select(
        *s.by, "ord", F.when(F.col("side") == "high", "EQH").otherwise("EQL").alias("type"), mean.alias("level"), "b.prev_index", F.col("i").alias("curr_index")
    )


def recent_equal_levels(s: Series, swing: int, share: float = 0.7, keep: int = 10) -> DataFrame:
    """The last ``keep`` equal levels whose newer pivot lies in the last part of the series."""
    n = s.bars.groupBy(*s.by).agg(F.count("*").alias("n"))
    late = equal_levels(s, swing).join(n, list(s.by)).where(F.col("curr_index") > F.col("n") * share).drop("n")
    return newest(late, s, ["ord"], keep)


def _labelled(p: DataFrame, s: Series, equal: tuple[str, str]) -> DataFrame:
    before = F.col("before")
    high = F.col("side") == "high"
    label = F.when(F.col("price") > before, F.when(high, "HH").otherwise("HL")).when(F.col("price") < before, F.when(high, "LH").otherwise("LL")).otherwise(F.when(high, equal[0]).otherwise(equal[1]))
    marked = K.carried(p, [*s.by, "side"], [F.col("i")], s.block(), {"before": F.col("price")}, own=False)
    out = marked.withColumn("label", label).where("before is not null")
    bias = F.when(F.col("label").isin("HH", "HL"), BULL).when(F.col("label").isin("LH", "LL"), BEAR).otherwise(0)
    return out.select(*s.by, "side", "i", "bar_ts", "price", "label", bias.alias("bias"))


def swing_labels(s: Series, swing: int) -> DataFrame:
    """HH, LH, HL, LL against the pivot before; equals count as LH and LL."""
    return _labelled(pivots(s, swing), s, ("LH", "LL"))


def fractals(s: Series) -> DataFrame:
    """Five-bar fractals, flat tops allowed to reach up to three bars right."""
    bars, w = s.near(2, 5)
    at = lambda c, k: (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w)

    def test(c: str, sign: int) -> Column:
        v = {k: sign * at(c, k) for k in (-2, -1, 1, 2, 3, 4, 5)}
        x = sign * F.col(c)
        left = (v[-2] < x) & (v[-1] < x)
        right = (
            ((v[1] < x) & (v[2] < x))
            | ((v[3] < x) & (v[2] < x) & (v[1] == x))
            | ((v[4] < x) & (v[3] < x) & (v[2] == x) & (v[1] <= x))
            | ((v[5] < x) & (v[4] < x) & (v[3] == x) & (v[2] == x) & (v[1] <= x))
        )
        return F.coalesce(left & right & v[2].isNotNull(), F.lit(False))

    cells = F.array_compact(F.array(
        F.when(test("high", 1), F.struct(F.lit("high").alias("side"), F.col("high").alias("price"))), F.when(test("low", -1), F.struct(F.lit("low").alias("side"), F.col("low").alias("price")))))
    found = bars.withColumn("cells", cells).where("halo_own").select(*s.by, "i", "bar_ts", F.explode("cells").alias("x")).select(*s.by, "i", "bar_ts", "x.side", "x.price")
    return _labelled(found, s, ("EH", "EL"))


def liquidity_sweeps(s: Series, internal: int, reach: int = 2000) -> DataFrame:
    """Pivots whose first break was a wick that closed back: one row each.

    The first bar beyond the pivot that does not close on it decides, among the
    ``reach`` bars after it (:func:`first_beyond`).
    """
    p = pivots(s, internal).select(*s.by, "side", F.col("i").alias("pivot_index"), "price")
    high = F.col("side") == "high"
    first = first_beyond(p, s, ["side", "pivot_index", "price"], F.col("pivot_index") + internal, F.col("pivot_index") + reach)
    wick = F.when(high, F.col("x.close") < F.col("price")).otherwise(F.col("x.close") > F.col("price"))
    return first.where(wick).select(
        *s.by, "pivot_index", F.col("price").alias("level"), F.col("x.i").alias("bar_index"), F.col("x.bar_ts").alias("bar_ts"),
        F.when(high, F.col("x.high")).otherwise(F.col("x.low")).alias("sweep_price"), F.when(high, BEAR).otherwise(BULL).alias("bias"),
    )


def sweep_areas(s: Series, internal: int, keep: int = 20, reach: int = 299) -> DataFrame:
    """Boxes between pivot and wick, until a close beyond the wick ends them."""
    sw = liquidity_sweeps(s, internal)
    order = [F.col("bar_index"), F.when(F.col("bias") == BEAR, 0).otherwise(1), F.col("pivot_index")]
    b = s.bars.select(*s.by, "i", F.col("bar_ts").alias("ts"), "close")
    last_ts = s.bars.groupBy(*s.by).agg(F.max("bar_ts").alias("last_ts"))
    recent = newest(sw, s, order, keep)
    beyond = F.when(F.col("bias") == BEAR, F.col("close") > F.col("sweep_price")).otherwise(F.col("close") < F.col("sweep_price"))
    hits = bars_between(recent, b, s.by, F.col("bar_index") + 2, F.col("bar_index") + reach).where(beyond)
    keys = [*s.by, "pivot_index", "bias"]
    ended = hits.groupBy(*keys).agg(F.min("ts").alias("end_ts"))
    out = recent.join(ended, keys, "left").join(last_ts, list(s.by))
    return out.select(*s.by, "pivot_index", F.col("bar_index").alias("start_index"), F.greatest("level", "sweep_price").alias("top"), F.least("level", "sweep_price").alias("bottom"), "bias", F.col("end_ts").isNotNull().alias("broken"), F.coalesce("end_ts", "last_ts").alias("end_ts"))


def breaker_blocks(s: Series, swing: int, internal: int, keep: int = 10) -> DataFrame:
    """Opposite order blocks that were passed before the break and touched after it."""
    s = s.keep()
    o = _origins(s, structures(s, swing, internal), "high")
    b = s.bars.select(*s.by, "i", "high", "low", "close")
    up = F.col("bias") == BULL
    passed = (F.col("i") < F.col("end_index")) & F.when(up, F.col("high") > F.col("ob_high")).otherwise(F.col("low") < F.col("ob_low"))
    touched = (F.col("i") >= F.col("end_index")) & F.when(up, (F.col("low") <= F.col("ob_high")) & (F.col("close") >= F.col("ob_low"))).otherwise((F.col("high") >= F.col("ob_low")) & (F.col("close") <= F.col("ob_high")))
    keys = [*s.by, "ord", "bias", "ob_index", "ob_high", "ob_low", "ob_ts"]
    tested = bars_between(o, b, s.by, F.col("ob_index") + 1, F.col("end_index") + 29).groupBy(*keys).agg(F.max(passed).alias("passed"), F.max(touched).alias("touched"))
    return newest(tested.where("passed and touched"), s, ["ord"], keep).select(*s.by, "ord", F.col("ob_index").alias("bar_index"), F.col("ob_ts").alias("bar_ts"), "ob_high", "ob_low", "bias")


def candle_trends(s: Series, internal: int, ahead: int = 9) -> DataFrame:
    """``trend`` of every bar: the last turn that has taken effect. A turn takes
    effect when all turns listed before it have."""
    s = s.keep()
    turns = _listed(s, _crossings(s, internal, ahead)).where("before is null or before <> bias")
    held = K.with_entries(turns, list(s.by), s.block("ord"), {"scan_end": (F.max("end_index"), lambda c, v: F.max(c).over(v))})
    so_far = F.max("end_index").over(K.inside(list(s.by), "ord").rowsBetween(Window.unboundedPreceding, 0))
    effective = held.withColumn("at", F.greatest(so_far, "scan_end"))
    at = effective.groupBy(*s.by, F.col("at").alias("i")).agg(F.max_by("bias", "ord").alias("turn"))
    marked = s.bars.join(at, [*s.by, "i"], "left")
    return K.carried(marked, list(s.by), [F.col("i")], s.block(), {"trend": F.col("turn")}).select(*s.by, "i", "bar_ts", F.coalesce("trend", F.lit(0)).alias("trend"))


def trading_range(s: Series, swing: int, internal: int, known: DataFrame | None = None) -> DataFrame:
    """The last swing high and low, widened to the last 50 bars where price has
    left them; which side is strong; one row per series with both."""
    s = s.keep()
    p = pivots(s, swing).groupBy(*s.by).agg(F.max_by("price", F.when(F.col("side") == "high", F.col("i"))).alias("sh"), F.max_by("price", F.when(F.col("side") == "low", F.col("i"))).alias("sl"))
    tail = newest(s.bars, s, ["i"], 50).groupBy(*s.by).agg(F.max("high").alias("h50"), F.min("low").alias("l50"), F.max_by("close", "i").alias("price"))
    j = p.where("sh is not null and sl is not null").join(tail, list(s.by)).join(trend(s, internal, known), list(s.by), "left")
    bullish = F.coalesce(F.col("trend_bias") == BULL, F.lit(False))
    high, low = F.when(F.col("price") > F.col("sh"), F.col("h50")).otherwise(F.col("sh")), F.when(F.col("price") < F.col("sl"), F.col("l50")).otherwise(F.col("sl"))
    return j.select(
        *s.by, high.alias("swing_high"), low.alias("swing_low"), F.coalesce("trend_bias", F.lit(0)).alias("trend_bias"),
        F.when(bullish, low).alias("strong_low"), F.when(bullish, high).alias("weak_high"), F.when(~bullish, high).alias("strong_high"), F.when(~bullish, low).alias("weak_low"), "price",
    )
