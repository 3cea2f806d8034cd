"""Trade journals: reading them, and how they kept to their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import n_if, q, rate
from . import scan as K

#: Names under which a journal's columns are known.
SYNONYMS = {
    "opened_at": ("opened_at", "open time", "entry time", "date", "time", "opened"),
    "symbol": ("symbol", "pair", "market", "instrument", "ticker"),
    "side": ("side", "direction", "type", "position"),
    "pnl": ("pnl", "p&l", "profit", "profit/loss", "realized pnl", "net profit"),
    "r": ("r", "r multiple", "r-multiple", "rr"),
    "rule": ("rule", "setup", "strategy", "tag"),
}


def mapped(raw: DataFrame) -> DataFrame:
    """A journal's columns under their usual names; unknown columns stay."""
    known = {s: name for name, all_ in SYNONYMS.items() for s in all_}
    taken: set[str] = set()
    out = []
    for c in raw.columns:
        name = known.get(c.strip().lower().replace("_", " "), known.get(c.strip().lower()))
        if name and name not in taken:
            taken.add(name)
            out.append(F.col(f"`{c}`").alias(name))
        else:
            out.append(F.col(f"`{c}`"))
    return raw.select(*out)


def review(journal: DataFrame, by: list[str], order: str | list[str] = "opened_at", value: str = "pnl") -> DataFrame:
    """Profit factor, expectancy and the longest run of losses. A run is an
    island of losses: its rows share the difference of their places among all
    trades and among losses, both counted by blocks of the first of ``order``."""
    order = [order] if isinstance(order, str) else order
    lost = F.col(value) < 0
    t = journal.withColumn("lost", lost)
    block = K.block_of(t, order[0])
    placed = K.numbered(t.select(*by, *order, "lost"), by, order, block, "place")
    losses = K.numbered(placed.where("lost"), by, order, block, "nth_loss")
    runs = losses.groupBy(*by, (F.col("place") - F.col("nth_loss")).alias("island")).agg(F.count("*").alias("run")).groupBy(*by).agg(F.max("run").alias("max_losses"))
    won = F.sum(F.when(F.col(value) > 0, F.col(value)).otherwise(0.0))
    gave = -F.sum(F.when(lost, F.col(value)).otherwise(0.0))
    done = t.groupBy(*by).agg(F.count("*").alias("trades"), rate(n_if(F.col(value) > 0), F.count("*")).alias("win_pct"), q(F.try_divide(won, gave), 4).alias("profit_factor"), q(F.avg(value), 4).alias("expectancy"))
    return done.join(runs, by, "left").withColumn("max_losses", F.coalesce("max_losses", F.lit(0)))


def compliance(journal: DataFrame, rule: str = "rule", kept: str = "kept", value: str = "pnl") -> DataFrame:
    """Per rule: how often it was kept, and what that was worth."""
    yes = F.col(kept)
    return journal.groupBy(rule).agg(
        F.count("*").alias("trades"), rate(n_if(yes), F.count("*")).alias("kept_pct"), q(F.avg(F.when(yes, F.col(value))), 4).alias("avg_kept"), q(F.avg(F.when(~yes, F.col(value))), 4).alias("avg_broken")
    )


def alignment(trends: DataFrame, columns: list[str]) -> DataFrame:
    """Full, Partial or Conflict from the trend signs of several timeframes."""
    cols = [F.col(c) for c in columns]
    ups, downs = sum((F.when(c > 0, 1).otherwise(0) for c in cols), F.lit(0)), sum((F.when(c < 0, 1).otherwise(0) for c in cols), F.lit(0))
    return trends.withColumn("alignment", F.when((ups == len(cols)) | (downs == len(cols)), "Full").when((ups > 0) & (downs > 0), "Conflict").otherwise("Partial"))
