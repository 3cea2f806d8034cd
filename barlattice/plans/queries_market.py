"""Registered queries of the trade store, of scans over all trades and of increments."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import folder_of, written_once
from ..functions.scalars import q
from ..operators import bars as B
from ..operators import flow as W
from ..operators import journal as J
from ..operators import outcomes as O
from ..operators import quantiles
from ..operators import scan as K
from ..sources import market as M
from ..sources import pages as P
from ..sources import store as L
from .queries import flags_as_text, indexed, query


@query
def a01_store_newest(spark, sf_dir):
    """The newest 5m candles of a store that is written from all trades."""
    store = L.save(M.ticks(spark, sf_dir), f"{folder_of(spark)}/store-{uuid.uuid4().hex}")
    return B.latest(B.resample(store.newest(300, limit=120), 300), 120)


@query
def a10_kline_pages(spark, sf_dir):
    """Candles from pages of a hundred that overlap and are there twice."""
    b = K.numbered(B.resample(M.ticks(spark, sf_dir), 300), ["symbol"], ["bar_ts"], K.day_of("bar_ts"), "k")
    ms = (F.unix_micros(F.col("bar_ts").cast("timestamp")) / 1000).cast("long")
    cells = F.array(ms.cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")])
    pages = P.paged(b, cells, 100)
    return P.candles(pages.union(pages))


@query
def a06_trade_pages(spark, sf_dir):
    """Trades from pages of five hundred that overlap, without the pages that hold errors."""
    t = K.numbered(M.ticks(spark, sf_dir), ["symbol"], ["ts", "trade_id"], K.day_of("ts"), "k")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    one = F.struct(F.col("trade_id").alias("a"), F.col("price").cast("string").alias("p"), F.col("qty").cast("string").alias("q"), ms.alias("T"), F.col("is_buyer_maker").alias("m"))
    pages = P.paged(t, one, 500)
    errors = pages.withColumn("payload", F.lit('{"code": -1003, "msg": "too many requests"}'))
    return P.trades(pages.unionByName(errors)).withColumn("ts", F.date_trunc("second", "ts"))


@query
def a01_day_index(spark, sf_dir):
    index = L.day_index(M.ticks(spark, sf_dir))
    filled = [F.col("bars")[s].alias(f"bars_{name}") for name, s in M.TIMEFRAMES.items() if s <= L.DAY]
    return index.select("symbol", F.col("day").cast("string").alias("day"), "n", "first_ts", "last_ts", *filled)


@query
def d05_price_quartiles(spark, sf_dir):
    """Quartiles of all trades' prices by symbol, in both markets."""
    both = M.ticks(spark, sf_dir).select("symbol", "price").unionByName(M.daily_trades(spark, sf_dir).select("symbol", "price"))
    out = quantiles.exact(both, ["symbol"], "price", [0.25, 0.5, 0.75])
    return out.select("symbol", "n", *[q(F.get("quantiles", F.lit(at)), 4).alias(name) for at, name in enumerate(("p25", "median", "p75"))])


@query
def of02_trade_cvd(spark, sf_dir):
    """The running signed volume after every single trade."""
    signed = M.ticks(spark, sf_dir).select("symbol", "ts", "trade_id", F.when(F.col("is_buyer_maker"), -F.col("qty")).otherwise(F.col("qty")).alias("signed"))
    return K.running_sums(signed, ["symbol"], ["ts", "trade_id"], K.day_of("ts"), {"cvd": "signed"}).select("symbol", "trade_id", q("cvd").alias("cvd"))


def positioning(spark, sf_dir) -> dict:
    """Funding and the four series of five markets, from ``orders`` by day and priority."""
    o = M.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.date_trunc("day", "o_orderdate").alias("ts"), "o_totalprice", "o_orderstatus", "o_custkey")
    day = o.groupBy("symbol", "ts")
    ratio = lambda yes: F.count(F.when(yes, 1)) / F.greatest(F.count(F.when(~yes, 1)), F.lit(1))
    series = {name: day.agg(ratio(yes).alias("ratio")) for name, yes in (("global_ratio", F.col("o_orderstatus") == "F"), ("top_ratio", F.col("o_totalprice") > 150_000), ("taker", F.col("o_custkey") % 2 == 0))}
    newest = F.max("ts")
    funding = o.groupBy("symbol").agg(F.max("o_totalprice").alias("mark_price"), (F.count("*") / 1e7).alias("rate"), (newest + F.make_dt_interval(F.lit(0), F.lit(8))).alias("next_ts"), (newest + F.make_dt_interval(F.lit(0), F.lit(1), F.lit(30))).alias("as_of"))
    return {"funding": funding, "open_interest": day.agg(F.count("*").cast("double").alias("oi"), q(F.sum("o_totalprice"), 2).alias("oi_value")), **series}


@query
def drv03_summary(spark, sf_dir):
    out = W.derivatives(**positioning(spark, sf_dir), period="1d", limit=30)["summary"]
    return out.select("symbol", "period", "hours", *[q(c, 4).alias(c) for c in out.columns if c not in ("symbol", "period", "limit", "hours") and not c.endswith("_trend")], *[c for c in out.columns if c.endswith("_trend")])


@query
def drv03_series(spark, sf_dir):
    return W.derivatives(**positioning(spark, sf_dir), period="1d", limit=30)["series"].withColumn("value", q("value", 4))


def journal(spark, sf_dir):
    """A trade journal from ``orders``, under the names that a broker gives."""
    o = M.table(spark, sf_dir, "orders")
    own = o.select("o_orderkey", F.col("o_orderdate").alias("Open Time"), F.col("o_orderpriority").alias("Pair"), (F.col("o_totalprice") - 150_000).alias("P&L"), F.col("o_orderstatus").alias("Setup"), (F.col("o_custkey") % 3 != 0).alias("kept"))
    return J.mapped(own)


@query
def l01_journal_review(spark, sf_dir):
    return J.review(journal(spark, sf_dir), ["symbol"], ["opened_at", "o_orderkey", "pnl"])


@query
def l02_compliance(spark, sf_dir):
    return J.compliance(journal(spark, sf_dir))


@query
def l03_alignment(spark, sf_dir):
    """Whether the last hour, the last four hours and the day of each symbol point one way."""
    def last(seconds: int, name: str):
        b = B.resample(M.ticks(spark, sf_dir), seconds).withColumn("day", F.to_date("bar_ts"))
        return b.groupBy("symbol", "day").agg(F.max_by(F.signum(F.col("close") - F.col("open")), "bar_ts").alias(name))

    signs = last(3600, "h1").join(last(14400, "h4"), ["symbol", "day"]).join(last(86400, "d1"), ["symbol", "day"])
    return J.alignment(signs, ["h1", "h4", "d1"]).select("symbol", F.col("day").cast("string").alias("day"), "alignment")


@query
def smc15_appended(spark, sf_dir):
    """Outcomes of the whole history from those of its first 22 days and the bars since."""
    whole = written_once(indexed(spark, sf_dir, 3600), "history")
    early = whole.where(F.col("bar_ts") < F.lit("2024-01-23").cast("timestamp_ntz"))
    stored = written_once(O.evaluated(early), "outcomes")
    return flags_as_text(O.extended(stored, whole, early.groupBy("symbol").agg(F.count("*").alias("seen"))))
