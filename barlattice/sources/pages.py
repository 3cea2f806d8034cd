"""Saved pages of market data: JSON arrays of trades or candles, as exchanges send them.

A page is a row with its ``symbol``, its number ``page`` and its ``payload``. Pages may
overlap, come in any order and repeat; a payload that is no array (an error that was
saved, a page cut short) has no rows and is listed by :func:`rejected`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRADE = "struct<a:long,p:string,q:string,T:long,m:boolean>"


def _time(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def trades(pages: DataFrame) -> DataFrame:
    """Trades of pages of ``{"a": id, "p": price, "q": quantity, "T": ms, "m": whether the
    buyer is the maker}``, each id of a symbol once."""
    one = F.from_json("payload", f"array<{TRADE}>")
    each = pages.select("symbol", F.explode(one).alias("t")).where("t.a is not null and t.T is not null")
    out = each.select(
        "symbol", _time(F.col("t.T")).alias("ts"), F.col("t.a").alias("trade_id"), F.col("t.p").cast("double").alias("price"), F.col("t.q").cast("double").alias("qty"), F.col("t.m").alias("is_buyer_maker")
    )
    return out.dropDuplicates(["symbol", "trade_id"])


def candles(pages: DataFrame) -> DataFrame:
    """Candles of pages of arrays ``[open time in ms, "open", "high", "low", "close", "volume",
    ...]``, each time of a symbol once: of several the one of the first page."""
    each = pages.select("symbol", "page", F.explode(F.from_json("payload", "array<array<string>>")).alias("k")).where("size(k) >= 6 and k[0] is not null")
    values = [F.col("k")[i].cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)]
    rows = each.select("symbol", "page", _time(F.col("k")[0].cast("long")).alias("bar_ts"), *values)
    first = rows.groupBy("symbol", "bar_ts").agg(F.min_by(F.struct("open", "high", "low", "close", "volume"), "page").alias("x"))
    return first.select("symbol", "bar_ts", "x.*")


def rejected(pages: DataFrame) -> DataFrame:
    """``symbol, page, payload`` of pages that hold no array."""
    return pages.where(F.from_json("payload", "array<string>").isNull())


def paged(rows: DataFrame, element: Column, size: int, index: str = "k") -> DataFrame:
    """Rows numbered by ``index`` in each symbol as pages of ``size``, each of which
    ends with the first element of the next."""
    page = F.floor(F.col(index) / size)
    again = F.when((F.col(index) % size == 0) & (page > 0), page - 1)
    dealt = rows.withColumn("page", F.explode(F.array_compact(F.array(page, again))))
    held = F.array_sort(F.collect_list(F.struct(F.col(index), element.alias("e"))))
    return dealt.groupBy("symbol", "page").agg(F.to_json(F.transform(held, lambda x: x["e"])).alias("payload"))
