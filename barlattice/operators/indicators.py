"""Volatility indicators: windows over blocks of a symbol's candles, each with as
many candles of the block before as the window looks back."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import over, q
from . import scan as K

#: Periods in a year of 365 days.
PER_YEAR = {"1m": 525600, "5m": 105120, "15m": 35040, "1h": 8760, "4h": 2190, "1d": 365, "1w": 52}


def near() -> WindowSpec:
    """The candles of a block, in order."""
    return K.over_halo(["symbol"])


def last(n: int) -> WindowSpec:
    return near().rowsBetween(1 - n, 0)


def _true_range(first_bar: bool = False) -> Column:
    before = F.lag("close").over(near())
    size = F.col("high") - F.col("low")
    tr = F.greatest(size, F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return F.when(before.isNotNull(), tr).otherwise(size if first_bar else F.lit(None))


def true_range(bars: DataFrame, *, first_bar: bool = False) -> DataFrame:
    """``tr``; the first bar's is null, or its own range with ``first_bar``."""
    return K.own(K.halo(bars, 1).withColumn("tr", _true_range(first_bar)))


def atr(bars: DataFrame, n: int) -> DataFrame:
    """``atr``: mean of the last ``n`` true ranges, null until there are so many."""
    ranged = K.halo(bars, n).withColumn("tr", _true_range())
    return K.own(ranged.withColumn("atr", F.when(F.col("bar_idx") >= n, q(F.avg("tr").over(last(n))))))


def atr_at_entry(bars: DataFrame, n: int) -> DataFrame:
    """``atr_entry``: mean over the last ``n`` bars, the first of which counts
    with its own range; fewer bars at the start will do."""
    ranged = K.halo(bars, n).withColumn("tr", _true_range(first_bar=True))
    rest = F.sum("tr").over(near().rowsBetween(2 - n, 0))
    head = F.lag(F.col("high") - F.col("low"), n - 1).over(near())
    return K.own(ranged.withColumn("atr_entry", q((rest + F.coalesce(head, F.lit(0.0))) / F.least(F.col("bar_idx") + 1, F.lit(n)))))


def wilder_atr(bars: DataFrame, n: int) -> DataFrame:
    """``wilder``: mean of the first ``n`` true ranges, then (prior * (n-1) + tr) / n.

    Each bar is a map ``x -> x * (n-1)/n + tr/n``, the ``n``-th one a constant, and
    maps compose: blocks of bars are folded apart and entered with what the blocks
    before give (:func:`scan.affine`).
    """
    ranged = true_range(bars, first_bar=True).select("symbol", "bar_idx", "tr")
    firsts = ranged.where(F.col("bar_idx") < n).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("bar_idx", "tr"))).alias("firsts")).where(F.size("firsts") == n)
    seed = firsts.select("symbol", (F.aggregate("firsts", F.lit(0.0), lambda s, x: s + x["tr"]) / n).alias("seed"))
    later = ranged.where(F.col("bar_idx") >= n - 1).join(seed, "symbol").withColumn("k", F.col("bar_idx") - (n - 1))
    first = F.col("k") == 0
    step = lambda x, bar: F.when(bar["k"] == 0, bar["v"]).otherwise((x * (n - 1) + bar["v"]) / n)
    later = later.withColumn("v", F.when(first, F.col("seed")).otherwise(F.col("tr")))
    run = K.affine(later, ["symbol"], "k", F.when(first, 0.0).otherwise((n - 1) / n), F.when(first, F.col("seed")).otherwise(F.col("tr") / n), "wilder", step, "v")
    return run.select("symbol", (F.col("k") + n - 1).alias("bar_idx"), q("wilder").alias("wilder"))


def log_returns(bars: DataFrame) -> DataFrame:
    """``log_return``, null at the first bar and where a price is not positive."""
    return K.own(K.halo(bars, 1).withColumn("log_return", _log_return()))


def _log_return() -> Column:
    before = F.lag("close").over(near())
    return F.when((before > 0) & (F.col("close") > 0), F.log(F.col("close") / before))


def realized_vol(bars: DataFrame, n: int, per_year: int) -> DataFrame:
    """``realized_vol``: yearly percent from the last ``n`` log returns."""
    sd = F.stddev_samp("log_return").over(last(n))
    known = K.halo(bars, n).withColumn("log_return", _log_return())
    return K.own(known.withColumn("realized_vol", F.when(F.col("bar_idx") >= n, q(sd * math.sqrt(per_year) * 100, 4))))


def band_width(bars: DataFrame, n: int = 20, sds: float = 2.0) -> DataFrame:
    """``width``: Bollinger band width over its middle, full frames only."""
    mid, sd = F.avg("close").over(last(n)), F.stddev_pop("close").over(last(n))
    return K.own(K.halo(bars, n).withColumn("width", F.when((F.col("bar_idx") >= n - 1) & (mid > 0), q(2 * sds * sd / mid))))


def squeeze(bars: DataFrame, n: int = 20, look: int = 100) -> DataFrame:
    """``squeeze_pct``: share of the last ``look`` widths that are not above the newest."""
    widths = K.numbered(band_width(bars, n).where("width is not null"), ["symbol"], ["bar_idx"], K.width_of("bar_idx"), "width_idx")
    ahead = F.collect_list("width").over(K.over_halo(["symbol"], "width_idx").rowsBetween(1 - look, 0))
    share = F.size(F.filter(ahead, lambda w: w <= F.col("width"))) / F.size(ahead)
    return K.own(K.halo(widths, look, index="width_idx").withColumn("squeeze_pct", q(share * 100, 4))).drop("width_idx")


def prior_median(days: DataFrame, value: str, n: int = 30, least: int = 5) -> Column:
    """Median of the ``n`` days before, null with fewer than ``least``."""
    w = over("day").rowsBetween(-n, -1)
    return F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w))


def adr_used(days: DataFrame, n: int = 14) -> DataFrame:
    """The newest day's range against the mean of the ``n`` days before it."""
    w = over("day").rowsBetween(-n, -1)
    newest = F.row_number().over(over(F.col("day").desc()))
    out = days.withColumn("adr", F.avg("day_range").over(w)).withColumn("newest", newest).where("newest = 1")
    return out.select("symbol", "day", q("day_range").alias("today_range"), q("adr").alias("adr"), q(F.try_divide(F.col("day_range"), F.col("adr")) * 100, 4).alias("used_pct"))


def volatility_state(bars: DataFrame, per_year: int) -> DataFrame:
    """One row per symbol, of its newest bar: ATRs, volatility, squeeze, state."""
    wide = squeeze(realized_vol(atr(bars, 14).withColumnRenamed("atr", "atr14"), 30, per_year).drop("tr"))
    ranged = K.halo(wide, 50).withColumn("tr", _true_range())
    wide = K.own(ranged.withColumn("atr50", F.when(F.col("bar_idx") >= 50, q(F.avg("tr").over(last(50))))))
    ratio = F.try_divide(F.col("atr14"), F.col("atr50"))
    state = F.when(F.col("squeeze_pct") <= 25, "contracting").when(ratio >= 1.15, "expanding").when(ratio <= 0.85, "contracting").otherwise("neutral")
    figures = ["bar_ts", "atr14", "atr50", "realized_vol", "width", "squeeze_pct", "state"]
    return wide.withColumn("state", state).groupBy("symbol").agg(F.max_by(F.struct(*figures), "bar_idx").alias("x")).select("symbol", "x.*")


def pearson(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation per key: 0 for fewer than 3 pairs or a constant side, within -1 and 1."""
    agg = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.covar_pop(x, y).alias("cov"))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / (F.col("sx") * F.col("sy"))))
    return agg.withColumn("r", F.when((F.col("n") >= 3) & (F.col("sx") > 1e-12) & (F.col("sy") > 1e-12), q(r, 4)).otherwise(0.0))


#: More symbols than this are a matrix that nobody reads: pairs grow with their square.
MOST_SYMBOLS = 10


def return_pairs(bars: DataFrame) -> DataFrame:
    """Log returns of every pair of symbols (a before b) at the times that all
    symbols have; ``idx`` counts the returns. Of MOST_SYMBOLS symbols at most."""
    total = bars.select("symbol").distinct().count()
    if total > MOST_SYMBOLS:
        raise ValueError(f"{total} symbols are too many to correlate pair by pair; {MOST_SYMBOLS} at most")
    common = bars.groupBy("bar_ts").agg(F.countDistinct("symbol").alias("n")).where(F.col("n") == total).select("bar_ts")
    shared = bars.join(common, "bar_ts")
    shared = K.numbered(shared, ["symbol"], ["bar_ts"], K.day_of("bar_ts"))
    r = log_returns(shared).where("bar_idx > 0").select("symbol", "bar_idx", F.coalesce("log_return", F.lit(0.0)).alias("ret"))
    a, b = r.select(F.col("symbol").alias("a"), "bar_idx", F.col("ret").alias("x")), r.select(F.col("symbol").alias("b"), "bar_idx", F.col("ret").alias("y"))
    return a.join(b, "bar_idx").where("a < b").withColumn("idx", F.col("bar_idx") - 1)


def adr_ratio(bars: DataFrame, least_days: int = 3) -> DataFrame:
    """The newest day's range against the mean of all days before it, for symbols
    with ``least_days`` days; all 24 hours count."""
    days = bars.groupBy("symbol", F.to_date("bar_ts").alias("day")).agg((F.max("high") - F.min("low")).alias("size"))
    newest = F.max("day").over(Window.partitionBy("symbol"))
    marked = days.withColumn("newest", newest)
    prior, today = F.when(F.col("day") < F.col("newest"), F.col("size")), F.when(F.col("day") == F.col("newest"), F.col("size"))
    out = marked.groupBy("symbol").agg(F.count("*").alias("days"), F.max(today).alias("today"), F.avg(prior).alias("adr")).where(F.col("days") >= least_days)
    return out.select("symbol", "days", q("today").alias("today_range"), q("adr").alias("adr"), q(F.when(F.col("adr") > 0, F.col("today") / F.col("adr"))).alias("ratio"))


def correlations(bars: DataFrame) -> DataFrame:
    """Matrix rows ``a, b, n, r`` for a before b."""
    return pearson(return_pairs(bars), ["a", "b"], "x", "y").select("a", "b", "n", "r")


def base_read(bars: DataFrame, base: str, eps: float = 0.15) -> DataFrame:
    """How each symbol moves with ``base``: strength, direction, and whether the
    newer half differs from the older one."""
    pairs = return_pairs(bars).where((F.col("a") == base) | (F.col("b") == base)).withColumn("other", F.when(F.col("a") == base, F.col("b")).otherwise(F.col("a")))
    sizes = pairs.groupBy("other").agg(F.count("*").alias("m"))
    pairs = pairs.join(sizes, "other").withColumn("recent", F.col("idx") >= F.floor(F.col("m") / 2))
    whole = pearson(pairs, ["other"], "x", "y").select("other", "n", "r")
    halves = pearson(pairs, ["other", "recent"], "x", "y")
    old = halves.where("not recent").select("other", F.col("r").alias("r_prior"))
    new = halves.where("recent").select("other", F.col("r").alias("r_recent"))
    size = F.abs("r")
    shift = F.col("r_recent") - F.col("r_prior")
    return whole.join(old, "other").join(new, "other").select(
        "other", "n", "r", "r_prior", "r_recent",
        F.when(size > 0.7, "strong").when(size >= 0.4, "moderate").otherwise("weak").alias("strength"),
        F.when(F.col("r") >= 0.1, "same").when(F.col("r") <= -0.1, "opposite").otherwise("none").alias("direction"),
        F.when(shift > eps, "tightening").when(shift < -eps, "decoupling").otherwise("stable").alias("shift"),
    )


def ranked_read(read: DataFrame) -> DataFrame:
    """Rows of :func:`base_read` with their ``rank`` by the size of ``r``."""
    return read.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("r").desc(), "other")))
