"""Market views of tables: ticks, daily trades, positioning, sizing requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The schema of a candle table, for readers that need one.
CANDLE = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("bar_ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)

#: Seconds of each timeframe, and other spellings of their names.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800}
ALIASES = {"60": "1h", "60m": "1h", "h1": "1h", "240": "4h", "h4": "4h", "d": "1d", "daily": "1d", "w": "1w", "weekly": "1w", "m5": "5m", "m15": "15m", "m1": "1m"}


def normalize_timeframe(name: str) -> str:
    """The usual name of a timeframe; ValueError if it is none."""
    low = name.strip().lower()
    found = ALIASES.get(low, low)
    if found not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {name!r}; known: {', '.join(TIMEFRAMES)}")
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from ``events``: symbol, ts, trade_id, price, qty, is_buyer_maker."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("trade_id"),
        (F.lit(100.0) + F.col("value")).alias("price"),
        (k + 1).cast("double").alias("qty"),
        (k % 2 == 0).alias("is_buyer_maker"),
    )


def daily_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from ``lineitem``, by day; ``rank_key`` orders the trades of a day."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.struct(*keys).alias("rank_key"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
    )


def positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily positioning from ``orders``: open interest, long/short ratio, taker volumes."""
    o = table(spark, sf_dir, "orders")
    longs, shorts = F.count(F.when(F.col("o_orderstatus") == "F", 1)), F.count(F.when(F.col("o_orderstatus") != "F", 1))
    return o.groupBy(F.date_trunc("day", "o_orderdate").alias("ts")).agg(
        F.count("*").cast("double").alias("oi"),
        (F.try_divide(longs, F.greatest(shorts, F.lit(1)))).alias("ratio"),
        longs.cast("double").alias("buy_vol"),
        shorts.cast("double").alias("sell_vol"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position requests from ``customer``: equity, risk, entry, stop, target."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("request_id"),
        (F.abs("c_acctbal") + 1).alias("equity"),
        (F.lit(0.5) + (k % 5) * 0.5).alias("risk_pct"),
        (F.lit(100.0) + k % 50).alias("entry"),
        (F.lit(100.0) + k % 50 + F.when(k % 2 == 0, -5.0).otherwise(4.0)).alias("stop"),
        F.when(k % 3 != 0, F.lit(100.0) + k % 50 + F.when(k % 2 == 0, 15.0).otherwise(-10.0)).alias("target"),
        F.lit(None).cast("string").alias("side"),
        (1 + k % 10).cast("double").alias("leverage"),
    )


def venue(symbol: str | object = "symbol"):
    """fx for symbols with an underscore, else crypto."""
    return F.when(F.contains(F.col(symbol), F.lit("_")), "fx").otherwise("crypto")


def parse_klines(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Rows of JSON arrays [openTimeMs, "o", "h", "l", "c", "v", ...] to candles."""
    cells = F.from_json(column, "array<string>")
    return raw.select(
        *[c for c in raw.columns if c != column],
        F.timestamp_millis(cells[0].cast("long")).cast("timestamp_ntz").alias("bar_ts"),
        *[cells[i].cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)],
    )


#: Most candles of one scan, by venue.
MOST = {"crypto": 1000, "fx": 5000}


def scan(candles: DataFrame, symbols: list[str] | None = None, start=None, end=None, limit: int | None = None, complete: str | None = None, most: int = 1000) -> DataFrame:
    """A range of candles, once each, newest ``limit`` (1 to ``most``, of MOST) per
    symbol; ``complete`` names a flag that is false for bars still forming.

    Filters reach the reader; the newest are picked by a limit within the window.
    """
    if symbols is not None:
        candles = candles.where(F.col("symbol").isin(symbols))
    if start is not None:
        candles = candles.where(F.col("bar_ts") >= F.lit(start))
    if end is not None:
        candles = candles.where(F.col("bar_ts") < F.lit(end))
    if complete is not None:
        candles = candles.where(F.col(complete))
    candles = candles.dropDuplicates(["symbol", "bar_ts"])
    if limit is not None:
        from ..operators.bars import latest

        candles = latest(candles, max(1, min(most, limit)))
    return candles


def crypto_only(*symbols: str) -> None:
    """ValueError for a symbol of another venue."""
    for s in symbols:
        if "_" in s:
            raise ValueError(f"{s!r} looks like a forex pair; this endpoint takes crypto symbols")


#: Watchlists by their names.
WATCHLISTS = {
    "crypto": ["BTCUSDT", "ETHUSDT", "SOLUSDT", "BNBUSDT", "XRPUSDT", "DOGEUSDT", "AVAXUSDT", "LINKUSDT"],
    "forex": ["EUR_USD", "GBP_USD", "USD_JPY", "AUD_USD", "USD_CAD", "XAU_USD"],
    "indices": ["NAS100_USD", "SPX500_USD", "US30_USD", "DE30_EUR", "UK100_GBP"],
}
_OTHER_NAMES = {"fx": "forex", "metals": "forex", "index": "indices"}


def watchlist(symbols: str = "", most: int = 15) -> list[str]:
    """The symbols of a watchlist's name, or those listed (by commas or spaces),
    upper case, once each, ``most`` at most; the crypto list for nothing."""
    name = symbols.strip().lower()
    if not name:
        return list(WATCHLISTS["crypto"])
    known = WATCHLISTS.get(_OTHER_NAMES.get(name, name))
    return list(known) if known else list(dict.fromkeys(s.upper() for s in symbols.replace(",", " ").split()))[:most]


def series_of(required: dict[str, DataFrame], optional: dict[str, DataFrame | None], by: list[str]) -> DataFrame:
    """Series of one column each (named by its key) on the rows that all required
    ones have; of an optional one that is missing, or lacks a row, the column is null."""
    out = None
    for name, df in required.items():
        own = df.select(*by, F.col(name))
        out = own if out is None else out.join(own, by)
    for name, df in optional.items():
        out = out.withColumn(name, F.lit(None).cast("double")) if df is None else out.join(df.select(*by, F.col(name)), by, "left")
    return out
