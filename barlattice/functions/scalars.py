"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SESSIONS = ("asia", "london", "new_york")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def q(x, places: int = 6) -> Column:
    """Half-up on the scaled value, the same arithmetic in every engine."""
    scale = float(10**places)
    return F.floor(col(x) * scale + 0.5) / scale


def rate(part, whole, places: int = 1) -> Column:
    """Percent, 0 for an empty whole."""
    return F.coalesce(q(F.try_divide(col(part) * 100.0, col(whole).cast("double")), places), F.lit(0.0))


def n_if(condition: Column) -> Column:
    """How many rows meet a condition; null counts as not met."""
    return F.count(F.when(condition, 1))


def hhmm(ts) -> Column:
    return F.date_format(ts, "HH:mm")


def weekday(day) -> Column:
    return F.date_format(day, "EEEE")


def minutes(ts) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def clock(minute_of_day) -> Column:
    """Minutes to HH:MM, halves rounded up."""
    m = F.floor(col(minute_of_day) + 0.5)
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def session(hour) -> Column:
    """Sessions of statistics and levels: asia 0-8, london 8-13, new_york 13-21, else null."""
    h = col(hour)
    return F.when(h < 8, "asia").when(h < 13, "london").when(h < 21, "new_york")


def smc_session(hour) -> Column:
    return F.coalesce(session(hour), F.lit("off_hours"))


def ict_session(hour) -> Column:
    """Sessions of the intraday concepts: asia 0-7, london 7-13, ny 13-21, else null."""
    h = col(hour)
    return F.when(h < 7, "asia").when(h < 13, "london").when(h < 21, "ny")


def confidence(n) -> Column:
    """HIGH from 50, MEDIUM from 20, LOW from 5, else INSUFFICIENT."""
    n = col(n)
    return F.when(n >= 50, "HIGH").when(n >= 20, "MEDIUM").when(n >= 5, "LOW").otherwise("INSUFFICIENT")


def confidence_b(n) -> Column:
    """insufficient under 10, low under 30, normal under 100, else high."""
    n = col(n)
    return F.when(n < 10, "insufficient").when(n < 30, "low").when(n < 100, "normal").otherwise("high")


def tick_of(price) -> Column:
    """Footprint tick by price."""
    p = col(price)
    return F.when(p > 10000, 50.0).when(p > 1000, 10.0).when(p > 100, 1.0).when(p > 10, 0.5).when(p > 1, 0.1).otherwise(0.01)


def nice(x) -> Column:
    """The nearest of 1, 2, 5 and 10 times a power of ten."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(col(x))))
    lead = col(x) / power
    return power * F.when(lead <= 1.5, 1.0).when(lead <= 3.5, 2.0).when(lead <= 7.5, 5.0).otherwise(10.0)


def large_trade(symbol, thresholds: dict[str, float] | None = None, default: float = 10_000.0) -> Column:
    """Quote size from which a trade is large."""
    out = F.lit(default)
    for name, value in (thresholds or {"BTCUSDT": 50_000.0, "ETHUSDT": 25_000.0, "SOLUSDT": 10_000.0}).items():
        out = F.when(col(symbol) == name, value).otherwise(out)
    return out


def over(*order, by=("symbol",)):
    return Window.partitionBy(*by).orderBy(*order)


def spread(x, places: int = 6, prefix: str = "") -> list[Column]:
    """Distribution of a column: n, mean, min, max, quartiles, confidence."""
    quartiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.count(x).alias(f"{prefix}n"),
        q(F.avg(x), places).alias(f"{prefix}mean"),
        q(F.min(x), places).alias(f"{prefix}min"),
        q(F.max(x), places).alias(f"{prefix}max"),
        q(quartiles[0], places).alias(f"{prefix}p25"),
        q(quartiles[1], places).alias(f"{prefix}median"),
        q(quartiles[2], places).alias(f"{prefix}p75"),
        confidence_b(F.count(x)).alias(f"{prefix}confidence"),
    ]
