"""Candlestick patterns of one, two and three bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan as K

#: Labels of (pattern, direction).
LABELS = {
    ("doji", "neutral"): "doji", ("marubozu", "bullish"): "bullish marubozu", ("marubozu", "bearish"): "bearish marubozu", ("spinning_top", "neutral"): "spinning top",
    ("hammer", "bullish"): "hammer / hanging man", ("shooting_star", "bearish"): "shooting star / inverted hammer",
    ("engulfing", "bullish"): "bullish engulfing", ("engulfing", "bearish"): "bearish engulfing", ("harami", "bullish"): "bullish harami", ("harami", "bearish"): "bearish harami",
    ("piercing_darkcloud", "bullish"): "piercing line", ("piercing_darkcloud", "bearish"): "dark cloud cover", ("inside_bar", "neutral"): "inside bar",
    ("outside_bar", "bullish"): "bullish outside bar", ("outside_bar", "bearish"): "bearish outside bar", ("outside_bar", "neutral"): "outside bar",
    ("star", "bullish"): "morning star", ("star", "bearish"): "evening star", ("three_soldiers_crows", "bullish"): "three white soldiers", ("three_soldiers_crows", "bearish"): "three black crows",
}


class Bar:
    """Columns of the bar ``back`` bars ago."""

    def __init__(self, back: int):
        at = (lambda c: F.lag(c, back).over(K.over_halo(["symbol"]))) if back else F.col
        self.o, self.h, self.l, self.c = (at(x) for x in ("open", "high", "low", "close"))
        self.body = F.abs(self.c - self.o)
        self.size = self.h - self.l
        self.top, self.bottom = F.greatest(self.o, self.c), F.least(self.o, self.c)
        self.bull, self.bear = self.c > self.o, self.c < self.o

    def share(self, part: Column) -> Column:
        return F.when(self.size > 0, part / self.size).otherwise(0.0)


def sided(bullish: Column, bearish: Column) -> Column:
    return F.when(bullish, "bullish").when(bearish, "bearish")


def single(b: Bar) -> list[tuple[str, Column]]:
    up, down, body = b.share(b.h - b.top), b.share(b.bottom - b.l), b.share(b.body)
    some = b.size > 0
    full = some & (up <= 0.05) & (down <= 0.05) & (body >= 0.9)
    hammer = some & ~full & (down >= 0.6) & (up <= 0.2) & (body <= 0.3)
    star = some & ~full & (up >= 0.6) & (down <= 0.2) & (body <= 0.3)
    doji = some & ~full & ~hammer & ~star & (body <= 0.1)
    top = some & ~full & ~hammer & ~star & ~doji & (body > 0.1) & (body <= 0.3) & (up >= 0.25) & (down >= 0.25)
    return [
        ("marubozu", F.when(full, F.when(b.bull, "bullish").otherwise("bearish"))), ("hammer", F.when(hammer, "bullish")), ("shooting_star", F.when(star, "bearish")),
        ("doji", F.when(doji, "neutral")), ("spinning_top", F.when(top, "neutral")),
    ]


def double(p: Bar, b: Bar) -> list[tuple[str, Column]]:
    bodies = (b.body > 0) & (p.body > 0)
    engulfing = F.when(bodies, sided(p.bear & b.bull & (b.c >= p.o) & (b.o <= p.c), p.bull & b.bear & (b.o >= p.c) & (b.c <= p.o)))
    inner = bodies & (b.body < p.body) & (b.top <= p.top) & (b.bottom >= p.bottom)
    harami = F.when(engulfing.isNull() & inner, sided(p.bear & b.bull, p.bull & b.bear))
    mid = (p.o + p.c) / 2.0
    piercing = F.when(bodies, sided(p.bear & b.bull & (b.o < p.c) & (mid < b.c) & (b.c < p.o), p.bull & b.bear & (b.o > p.c) & (p.o < b.c) & (b.c < mid)))
    inside = (b.h <= p.h) & (b.l >= p.l)
    outside = ~inside & (b.h >= p.h) & (b.l <= p.l)
    return [
        ("engulfing", engulfing), ("harami", harami), ("piercing_darkcloud", piercing), ("inside_bar", F.when(inside, "neutral")),
        ("outside_bar", F.when(outside, F.when(b.bull, "bullish").when(b.bear, "bearish").otherwise("neutral"))),
    ]


def triple(a: Bar, m: Bar, b: Bar) -> list[tuple[str, Column]]:
    mid = (a.o + a.c) / 2.0
    star = F.when((a.body > 0) & (b.body > 0) & (m.share(m.body) <= 0.3), sided(a.bear & b.bull & (m.top < a.c) & (b.c >= mid), a.bull & b.bear & (m.bottom > a.c) & (b.c <= mid)))
    big = (a.share(a.body) >= 0.6) & (m.share(m.body) >= 0.6) & (b.share(b.body) >= 0.6)
    rise = a.bull & m.bull & b.bull & (m.c > a.c) & (b.c > m.c) & (a.c > m.o) & (m.o > a.o) & (m.c > b.o) & (b.o > m.o)
    fall = a.bear & m.bear & b.bear & (m.c < a.c) & (b.c < m.c) & (a.c < m.o) & (m.o < a.o) & (m.c < b.o) & (b.o < m.o)
    return [("star", star), ("three_soldiers_crows", F.when(big, sided(rise, fall)))]


def patterns(bars: DataFrame, spans: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per detection, in the order (bar, span, detector): all bars'
    detectors are columns of one pass, exploded where they hold."""
    b, p, a = Bar(0), Bar(1), Bar(2)
    found = [(1, n, d) for n, d in single(b)] + [(2, n, d) for n, d in double(p, b)] + [(3, n, d) for n, d in triple(a, p, b)]
    cells = F.array(*[F.when(d.isNotNull() & (F.col("bar_idx") >= s - 1), F.struct(F.lit(s).alias("span"), F.lit(k).alias("ordinal"), F.lit(n).alias("key"), d.alias("direction"))) for k, (s, n, d) in enumerate(found) if s in spans])
    labels = F.create_map(*[F.lit(x) for (n, d), label in LABELS.items() for x in (f"{n}/{d}", label)])
    out = K.halo(bars, max(spans)).withColumn("cells", cells).where("halo_own").select("symbol", "bar_idx", "bar_ts", "high", "low", F.explode(F.array_compact("cells")).alias("x"))
    return out.select("symbol", "bar_idx", "bar_ts", "high", "low", "x.span", "x.ordinal", "x.key", "x.direction", labels[F.concat_ws("/", "x.key", "x.direction")].alias("pattern"))
