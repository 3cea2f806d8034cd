"""Market profile: price rows, point of control, value area, touches of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hhmm, minutes, nice, over, q, weekday
from .sessions import CONVENTIONS

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def session_key(timeframe: str):
    """Start of the profile session that a bar belongs to."""
    hours = {"1m": 1, "5m": 4}
    if timeframe in hours:
        return F.window("bar_ts", f"{hours[timeframe]} hours")["start"]
    unit = {"15m": "day", "30m": "day", "1h": "day", "4h": "week"}.get(timeframe, "month")
    return F.date_trunc(unit, "bar_ts")


def ticks(bars: DataFrame, by: list[str]) -> DataFrame:
    """Per session: extremes, bars, tick and the grid of price rows."""
    size = F.col("high") - F.col("low")
    ranges = F.array_sort(F.collect_list(F.when(size > 0, size)))
    s = bars.groupBy(*by).agg(F.max("high").alias("hi"), F.min("low").alias("lo"), F.count("*").alias("n"), F.min("bar_ts").alias("start_ts"), F.max("bar_ts").alias("end_ts"), ranges.alias("ranges")).where("hi > lo")
    middle = F.element_at("ranges", (F.floor(F.size("ranges") / 2) + 1).cast("int"))
    s = s.withColumn("tick", F.when(F.size("ranges") > 0, nice(middle / 10)).otherwise(1.0)).drop("ranges")
    s = s.withColumns({"bottom": F.floor(F.col("lo") / F.col("tick")) * F.col("tick"), "top": F.ceil(F.col("hi") / F.col("tick")) * F.col("tick")})
    s = s.withColumn("rows", F.greatest(F.lit(1), F.floor((F.col("top") - F.col("bottom")) / F.col("tick") + 0.5)).cast("int"))
    wide = F.col("rows") > 200
    return s.withColumns({"tick": F.when(wide, (F.col("top") - F.col("bottom")) / 100).otherwise(F.col("tick")), "rows": F.when(wide, 100).otherwise(F.col("rows"))})


def spans(bars: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """The bars with the first and last price row that each touches (``j0``, ``j1``), in
    sessions of ``grid``. A row is touched that begins at or below the high and
    ends above the low."""
    b = bars.join(grid.select(*by, "bottom", "tick", "rows"), by)
    price = lambda j: q(F.col("bottom") + j * F.col("tick"), 10)
    near = lambda c: F.sequence(*[F.greatest(F.lit(0), F.least(F.col("rows") - 1, F.floor((F.col(c) - F.col("bottom")) / F.col("tick")).cast("int") + d)) for d in (-2, 2)])
    first = F.array_min(F.filter(near("low"), lambda j: F.col("low") < price(j) + F.col("tick")))
    last = F.array_max(F.filter(near("high"), lambda j: F.col("high") >= price(j)))
    return b.withColumns({"j0": first, "j1": last}).where("j0 <= j1").drop("bottom", "tick", "rows")


def price_rows(bars: DataFrame, by: list[str], letters: bool = False) -> DataFrame:
    """Per session and price row how many bars touch it, and with ``letters`` theirs.

    A sweep line: a bar adds one at the first row that it touches and takes it away
    behind the last, so a bar costs two entries however many rows it covers.
    """
    sessions = ticks(bars, by)
    grid = sessions.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("price", q(F.col("bottom") + F.col("j") * F.col("tick"), 10))
    touched = spans(bars, sessions, by)
    steps = F.array(F.struct(F.col("j0").alias("j"), F.lit(1).alias("step")), F.struct((F.col("j1") + 1).alias("j"), F.lit(-1).alias("step")))
    turns = touched.select(*by, F.explode(steps).alias("s")).groupBy(*by, "s.j").agg(F.sum("s.step").alias("turn"))
    upward = Window.partitionBy(*by).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    counted = grid.join(turns, [*by, "j"], "left").withColumn("count", F.coalesce(F.sum("turn").over(upward), F.lit(0))).drop("turn")
    if not letters:
        return counted
    k = F.row_number().over(Window.partitionBy(*by).orderBy("bar_ts")) - 1
    letter = F.when(F.col("k") < len(LETTERS), F.substr(F.lit(LETTERS), F.col("k") + 1, F.lit(1))).otherwise(F.col("k").cast("string"))
    lettered = spans(bars.withColumn("k", k), sessions, by).select(*by, F.struct("k", letter.alias("letter")).alias("x"), F.explode(F.sequence("j0", "j1")).alias("j"))
    named = lettered.groupBy(*by, "j").agg(F.array_sort(F.collect_list("x")).alias("x")).select(*by, "j", F.transform("x", lambda s: s["letter"]).alias("letters"))
    return counted.join(named, [*by, "j"], "left").withColumn("letters", F.coalesce("letters", F.expr("cast(array() as array<string>)")))


def value_area(counts, poc, total, share: float):
    """(val, vah) as a fold over an array of row counts, outward from the poc:
    two rows at a time to the heavier side, one towards the middle on a tie."""
    top = F.size(counts) - 1
    at = lambda i: F.when((i >= 0) & (i <= top), F.element_at(counts, F.least(F.greatest(i, F.lit(0)), top) + 1)).otherwise(0)
    start = F.struct(poc.alias("val"), poc.alias("vah"), (F.floor(total * share) - at(poc)).cast("long").alias("left"))

    def step(s, _):
        val, vah, left = s["val"], s["vah"], s["left"]
        u1, u2, d1, d2 = at(vah + 1).cast("long"), at(vah + 2).cast("long"), at(val - 1).cast("long"), at(val - 2).cast("long")
        at_top, at_bottom = vah >= top, val <= 0
        mid = F.floor((top + 1) / 2)
        up_first = F.abs(vah - mid) <= F.abs(val - mid)
        up = lambda n, cost: F.struct(val.alias("val"), (vah + n).alias("vah"), (left - cost).alias("left"))
        down = lambda n, cost: F.struct((val - n).alias("val"), vah.alias("vah"), (left - cost).alias("left"))
        stop = F.struct(val.alias("val"), vah.alias("vah"), F.lit(0).cast("long").alias("left"))
        return (
            F.when((left <= 0) | (at_top & at_bottom), stop)
            .when(at_top, F.when(d1 > 0, down(1, d1)).otherwise(stop))
            .when(at_bottom, F.when(u1 > 0, up(1, u1)).otherwise(stop))
            .when(u1 + u2 > d1 + d2, F.when(vah + 2 <= top, up(2, u1 + u2)).otherwise(up(1, u1)))
            .when(d1 + d2 > u1 + u2, F.when(val - 2 >= 0, down(2, d1 + d2)).otherwise(down(1, d1)))
            .otherwise(F.when(up_first, up(1, u1)).otherwise(down(1, d1)))
        )

    return F.aggregate(F.sequence(F.lit(0), top), start, step)


def profiles(bars: DataFrame, by: list[str], share: float = 0.6826) -> DataFrame:
    """One row per session: tick, poc, value area, counts."""
    rows = price_rows(bars, by)
    distance = F.abs(F.col("price") + F.col("tick") / 2 - (F.col("hi") + F.col("lo")) / 2)
    p = rows.groupBy(*by, "start_ts", "end_ts", "tick", "hi", "lo").agg(
        F.array_sort(F.collect_list(F.struct("j", "count", "price"))).alias("all"),
        F.min_by("j", F.struct(-F.col("count"), distance, "j")).alias("poc_j"), F.max("count").alias("poc_count"), F.sum("count").alias("total_tpos"),
    )
    va = value_area(F.transform("all", lambda x: x["count"]), F.col("poc_j"), F.col("total_tpos"), share)
    p = p.withColumn("va", va)
    price = lambda j: F.element_at("all", j + 1)["price"]
    return p.select(
        *by, "start_ts", "end_ts", "tick", (price(F.col("poc_j")) + F.col("tick") / 2).alias("poc"), (price(F.col("va.vah")) + F.col("tick")).alias("vah"), price(F.col("va.val")).alias("val"),
        "poc_count", "total_tpos", "poc_j", F.col("va.val").alias("val_j"), F.col("va.vah").alias("vah_j"),
    )


def zones(bars: DataFrame, by: list[str]) -> DataFrame:
    """The rows of each profile that any bar touched, with their zone."""
    p = profiles(bars, by).select(*by, "poc_j", "val_j", "vah_j")
    zone = F.when(F.col("j") == F.col("poc_j"), "poc").when(F.col("j").between(F.col("val_j"), F.col("vah_j")), "value").otherwise("outside")
    return price_rows(bars, by, letters=True).where("count > 0").join(p, by).select(*by, "j", "price", "count", F.concat_ws("", "letters").alias("letters"), zone.alias("zone"))


def recent_sessions(bars: DataFrame, timeframe: str, keep: int) -> DataFrame:
    """Bars of the last ``keep`` profile sessions of each symbol."""
    keyed = bars.withColumn("sess", session_key(timeframe))
    rank = F.dense_rank().over(over(F.col("sess").desc()))
    return keyed.withColumn("nth", rank).where(F.col("nth") <= keep).drop("nth")


def prior_profile_touches(fine: DataFrame, hourly: DataFrame, convention: str = "synthetic_ny") -> DataFrame:
    """Each day's regular-hours profile, and touches of the last one before it."""
    start, _, _, close = CONVENTIONS[convention]
    both = fine.select("symbol", F.to_date("bar_ts").alias("day")).distinct().join(hourly.select("symbol", F.to_date("bar_ts").alias("day")).distinct(), ["symbol", "day"])
    inside = (F.col("minute") >= start) & (F.col("minute") < close)
    rth = lambda b: b.withColumns({"day": F.to_date("bar_ts"), "minute": minutes("bar_ts")}).where(inside)
    f = rth(fine).join(both, ["symbol", "day"], "left_semi")
    many = f.groupBy("symbol", "day").agg(F.count("*").alias("n"), F.min_by("open", "bar_ts").alias("o"), F.max_by("close", "bar_ts").alias("c"), q(F.max("high") - F.min("low")).alias("rth_range")).where("n >= 2")
    p = profiles(f, ["symbol", "day"]).join(many, ["symbol", "day"])
    w = over("day")
    p = p.withColumns({**{x: q(x) for x in ("poc", "vah", "val")}})
    p = p.withColumns({f"prev_{x}": F.lag(x).over(w) for x in ("poc", "vah", "val")})
    h = rth(hourly).select("symbol", "day", "bar_ts", F.col("high").alias("h"), F.col("low").alias("l"))
    hit = lambda x: F.min(F.when((F.col("l") <= F.col(f"prev_{x}")) & (F.col(f"prev_{x}") <= F.col("h")), F.col("bar_ts")))
    keys = ["symbol", "day", "poc", "vah", "val", "prev_poc", "prev_vah", "prev_val", "total_tpos", "o", "c", "rth_range"]
    t = p.join(h, ["symbol", "day"], "left").groupBy(*keys).agg(*[hit(x).alias(f"{x}_at") for x in ("poc", "vah", "val")])
    return t.select(
        "symbol", "day", F.col("o").alias("rth_open"), F.col("c").alias("rth_close"), "poc", "vah", "val", "prev_poc", "prev_vah", "prev_val", "total_tpos", "rth_range",
        *[F.col(f"{x}_at").isNotNull().alias(f"touched_{x}") for x in ("poc", "vah", "val")], *[hhmm(f"{x}_at").alias(f"{x}_time") for x in ("poc", "vah", "val")], weekday("day").alias("day_of_week"),
    )
