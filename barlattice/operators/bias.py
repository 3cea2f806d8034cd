"""Period bias, intraday concepts and key levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ict_session, n_if, over, q, rate, session


def periods(bars: DataFrame, unit: str = "D") -> DataFrame:
    """Candles of days (D) or Monday weeks (W): ``symbol, day, o, h, l, c``."""
    key = F.to_date("bar_ts") if unit == "D" else F.to_date(F.date_trunc("week", "bar_ts"))
    return bars.groupBy("symbol", key.alias("day")).agg(F.min_by("open", "bar_ts").alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "bar_ts").alias("c"))


def bias_entries(bars: DataFrame, unit: str = "D") -> DataFrame:
    """Each period's bias from the two before it, and what it did to the levels
    of the one two before: hits, and closes through them."""
    w = over("day")
    p = {x: F.lag(x, 1).over(w) for x in "ohlc"}
    z = {x: F.lag(x, 2).over(w) for x in "ohlc"}
    d = periods(bars, unit).withColumns({**{f"p{x}": c for x, c in p.items()}, **{f"z{x}": c for x, c in z.items()}}).where("zo is not null")
    pc, zh, zl = F.col("pc"), F.col("zh"), F.col("zl")
    within = (pc > zl) & (pc < zh)
    bias = (
        F.when(pc > zh, 1)
        .when(pc < zl, -1)
        .when(within & (F.col("ph") > zh) & (F.col("pl") > zl), -1)
        .when(within & (F.col("ph") < zh) & (F.col("pl") < zl), 1)
        .when((F.col("ph") <= zh) & (F.col("pl") >= zl), F.when(F.col("zc") >= F.col("zo"), 1).otherwise(-1))
        .otherwise(0)
    )
    hit_high, hit_low = F.col("h") >= zh, F.col("l") <= zl
    return d.select(
        "symbol", "day", bias.alias("bias"), zh.alias("level_high"), zl.alias("level_low"), hit_high.alias("hit_high"), hit_low.alias("hit_low"),
        (hit_high & (F.col("c") > zh)).alias("closed_above"), (hit_low & (F.col("c") < zl)).alias("closed_below"),
    )


def bias_statistics(entries: DataFrame) -> DataFrame:
    """Hits and closes through, counted only where the bias asked for them."""
    bull, bear = F.col("bias") == 1, F.col("bias") == -1
    n_bull, n_bear = n_if(bull), n_if(bear)
    hit_b, hit_s = n_if(bull & F.col("hit_high")), n_if(bear & F.col("hit_low"))
    return entries.groupBy("symbol").agg(
        F.count("*").alias("n"), n_bull.alias("bullish"), n_bear.alias("bearish"), rate(hit_b, n_bull).alias("bull_hit_pct"), rate(hit_s, n_bear).alias("bear_hit_pct"),
        rate(n_if(bull & F.col("closed_above")), hit_b).alias("bull_close_pct"), rate(n_if(bear & F.col("closed_below")), hit_s).alias("bear_close_pct"),
    )


#: Hours of the phases of a day.
PHASES = {"acc": (0, 5), "man": (7, 10), "dis": (13, 17)}


def concept_days(bars: DataFrame) -> DataFrame:
    """Wide rows of days that have Asian bars: sessions, phases, mean range of
    up to 14 days before."""
    hour = F.hour("bar_ts")
    b = bars.withColumns({"day": F.to_date("bar_ts"), "hour": hour, "session": ict_session(hour)}).where("session is not null")
    aggs = [F.max("high").alias("day_high"), F.min("low").alias("day_low")]

    def own(prefix: str, inside: Column) -> list[Column]:
        at = F.when(inside, F.col("bar_ts"))
        return [
            F.max(F.when(inside, F.col("high"))).alias(f"{prefix}_h"), F.min(F.when(inside, F.col("low"))).alias(f"{prefix}_l"),
            F.min_by("open", at).alias(f"{prefix}_o"), F.max_by("close", at).alias(f"{prefix}_c"),
        ]

    for name in ("asia", "london", "ny"):
        aggs += own(name, F.col("session") == name)
    for name, (start, end) in PHASES.items():
        aggs += own(name, (F.col("hour") >= start) & (F.col("hour") < end))
    days = b.groupBy("symbol", "day").agg(*aggs).withColumn("day_range", F.col("day_high") - F.col("day_low"))
    adr = F.coalesce(F.avg("day_range").over(over("day").rowsBetween(-14, -1)), F.lit(0.0))
    return days.withColumn("adr", adr).where("asia_h is not null")


def draw_on_liquidity(bars: DataFrame) -> DataFrame:
    """The level that the day's bias draws to, and whether the day reached it."""
    d = concept_days(bars).join(bias_entries(bars), ["symbol", "day"]).where("bias <> 0")
    bull = F.col("bias") == 1
    return d.select(
        "symbol", "day", F.when(bull, "bullish").otherwise("bearish").alias("bias"), F.when(bull, F.col("level_high")).otherwise(F.col("level_low")).alias("dol_price"),
        F.when(bull, "PDH").otherwise("PDL").alias("dol_label"), F.when(bull, F.col("level_low")).otherwise(F.col("level_high")).alias("opposite_price"),
        F.when(bull, F.col("day_high") >= F.col("level_high")).otherwise(F.col("day_low") <= F.col("level_low")).alias("reached"),
    )


def _sweep_of_accumulation() -> tuple[Column, Column, Column]:
    up, down = F.col("man_h") > F.col("acc_h"), F.col("man_l") < F.col("acc_l")
    farther_up = F.col("man_h") - F.col("acc_h") > F.col("acc_l") - F.col("man_l")
    return up, down, farther_up


def phases(bars: DataFrame) -> DataFrame:
    """Accumulation, manipulation and distribution of each day, with their quality."""
    d = concept_days(bars)
    up, down, farther = _sweep_of_accumulation()
    moved = F.when(up & down, F.when(farther, "up_sweep").otherwise("down_sweep")).when(up, "up_sweep").when(down, "down_sweep").otherwise("")
    moved = F.when(F.col("acc_h").isNotNull() & F.col("man_h").isNotNull(), moved).otherwise("")
    after = (
        F.when(moved == "up_sweep", "bearish").when(moved == "down_sweep", "bullish").when(F.col("london_c") > F.col("london_o"), "bullish").when(F.col("london_c") < F.col("london_o"), "bearish").otherwise("")
    )
    share = {p: F.when(F.col("day_range") > 0, (F.col(f"{p}_h") - F.col(f"{p}_l")) / F.col("day_range") * 100).otherwise(0.0) for p in PHASES}
    tight = F.when(F.col("adr") > 0, (F.col("acc_h") - F.col("acc_l")) / F.col("adr") * 100).otherwise(0.0)

    def banded(x: Column, low: float, high: float, side: Column) -> Column:
        return F.when((x >= low) & (x <= high) & (side != ""), "clean").when(side != "", "messy").otherwise("")

    def row(name: str, p: str, present: Column, side: Column, quality: Column) -> Column:
        return F.when(present, F.struct(F.lit(name).alias("phase"), F.col(f"{p}_h").alias("high"), F.col(f"{p}_l").alias("low"), side.alias("direction"), q(share[p], 1).alias("range_pct"), quality.alias("quality")))

    acc, man, dis = (F.col(f"{p}_h").isNotNull() for p in PHASES)
    cells = F.array_compact(F.array(
        row("accumulation", "acc", acc, F.lit(""), F.when(tight < 30, "clean").when(tight > 50, "messy").otherwise("")),
        row("manipulation", "man", acc & man, moved, banded(share["man"], 20, 40, moved)),
        row("distribution", "dis", dis & man, after, banded(share["dis"], 50, 70, after)),
    ))
    return d.select("symbol", "day", F.explode(cells).alias("x")).select("symbol", "day", "x.*")


def judas_swings(bars: DataFrame) -> DataFrame:
    """False moves out of the accumulation range, and whether they were taken back."""
    d = concept_days(bars).where("acc_h is not null and man_h is not null")
    up, down, farther = _sweep_of_accumulation()
    upward = F.when(up & down, farther).otherwise(up)
    no = F.lit(False)
    back = F.when(
        upward, F.coalesce(F.col("london_c") < F.col("acc_h"), no) | (~(up & down) & F.coalesce(F.col("ny_c") < F.col("acc_h"), no))
    ).otherwise(F.coalesce(F.col("london_c") > F.col("acc_l"), no) | (~(up & down) & F.coalesce(F.col("ny_c") > F.col("acc_l"), no)))
    return d.where(up | down).select(
        "symbol", "day", F.when(upward, "up").otherwise("down").alias("direction"), F.when(upward, F.col("man_h")).otherwise(F.col("man_l")).alias("sweep_price"),
        F.col("acc_h").alias("asia_high"), F.col("acc_l").alias("asia_low"), back.alias("reversal_confirmed"),
    )


def session_biases(bars: DataFrame) -> DataFrame:
    """The bias that London gives against the accumulation, and New York against London."""
    d = concept_days(bars)
    up, down = F.col("london_h") > F.col("acc_h"), F.col("london_l") < F.col("acc_l")
    c, top, bottom = F.col("london_c"), F.col("acc_h"), F.col("acc_l")

    def cell(name: str, bias: Column, reason: Column, high: Column, low: Column, hit: Column) -> Column:
        return F.struct(F.lit(name).alias("session"), bias.alias("bias"), reason.alias("reason"), high.alias("target_high"), low.alias("target_low"), hit.alias("hit_target"))

    london = cell(
        "london",
        F.when(up & down, F.when(c > top, "bullish").when(c < bottom, "bearish").otherwise("neutral")).when(up, "bearish").when(down, "bullish").otherwise(F.when(c > (top + bottom) / 2, "bullish").otherwise("bearish")),
        F.when(up & down, F.when(c > top, "both_above").when(c < bottom, "both_below").otherwise("both_inside")).when(up, "high_swept").when(down, "low_swept").otherwise(F.when(c > (top + bottom) / 2, "none_above_mid").otherwise("none_below_mid")),
        top, bottom,
        F.when(up & down, (c > top) | (c < bottom)).when(up, c < top).when(down, c > bottom).otherwise(False),
    )
    n_up, n_down, rising = F.col("ny_h") > F.col("london_h"), F.col("ny_l") < F.col("london_l"), F.col("london_c") > F.col("london_o")
    only_up, only_down = n_up & ~n_down, n_down & ~n_up
    ny = cell(
        "ny",
        F.when(only_up, "bearish").when(only_down, "bullish").when(rising, "bullish").otherwise("bearish"),
        F.when(only_up, "london_high_swept").when(only_down, "london_low_swept").when(rising, "london_bullish").otherwise("london_bearish"),
        F.col("london_h"), F.col("london_l"),
        F.when(only_up, F.col("ny_c") < F.col("london_h")).when(only_down, F.col("ny_c") > F.col("london_l")).when(rising, n_up).otherwise(n_down),
    )
    has = lambda *xs: F.expr(" and ".join(f"{x}_h is not null" for x in xs))
    cells = F.array_compact(F.array(F.when(has("acc", "london"), london), F.when(has("london", "ny"), ny)))
    return d.select("symbol", "day", F.explode(cells).alias("x")).select("symbol", "day", "x.*")


def period_levels(bars: DataFrame) -> DataFrame:
    """Long rows ``symbol, label, price, at``: highs, lows and opens of the day,
    week and month of the newest bar, of those before, and of the sessions of
    the last two days."""
    now = bars.groupBy("symbol").agg(F.max("bar_ts").alias("now"))
    today = F.date_trunc("day", "now")
    cuts = {
        "D": (today, today - F.expr("interval 1 day")),
        "W": (F.date_trunc("week", "now"), F.date_trunc("week", "now") - F.expr("interval 7 days")),
        "M": (F.date_trunc("month", "now"), F.date_trunc("month", F.date_trunc("month", "now") - F.expr("interval 1 day"))),
    }
    b = bars.join(now, "symbol").withColumn("session", session(F.hour("bar_ts")))
    ts = F.col("bar_ts")
    tags = []
    for k, (start, before) in cuts.items():
        tags.append(F.when(ts >= start, F.lit(k)).when(ts >= before, F.lit(f"p{k}")))
    names = F.create_map(*[F.lit(x) for x in ("asia", "Asia", "london", "London", "new_york", "NY")])
    inside = F.when(ts >= cuts["D"][0], names[F.col("session")]).when(ts >= cuts["D"][1], F.concat(F.lit("p"), names[F.col("session")]))
    tagged = b.select("symbol", "bar_ts", "open", "high", "low", F.explode(F.array_compact(F.array(*tags, inside))).alias("tag"))
    g = tagged.groupBy("symbol", "tag").agg(
        F.max("high").alias("h"), F.min("low").alias("l"), F.min_by("open", "bar_ts").alias("o"), F.min("bar_ts").alias("o_at"),
        F.min_by("bar_ts", F.struct(-F.col("high"), "bar_ts")).alias("h_at"), F.min_by("bar_ts", F.struct("low", "bar_ts")).alias("l_at"),
    )
    opens = F.when(F.col("tag") == "D", F.struct(F.lit("D Open").alias("label"), F.col("o").alias("price"), F.col("o_at").alias("at"))).when(
        F.col("tag") == "W", F.struct(F.lit("Mon Open").alias("label"), F.col("o").alias("price"), F.col("o_at").alias("at"))
    )
    cells = F.array_compact(F.array(
        F.struct(F.concat("tag", F.lit(" High")).alias("label"), F.col("h").alias("price"), F.col("h_at").alias("at")),
        F.struct(F.concat("tag", F.lit(" Low")).alias("label"), F.col("l").alias("price"), F.col("l_at").alias("at")), opens,
    ))
    return g.select("symbol", F.explode(cells).alias("x")).select("symbol", "x.*").where("price > 0")
