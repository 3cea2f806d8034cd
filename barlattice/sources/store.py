"""Trades laid out by day and symbol bucket, with an index of days, so that the
newest candles are read from the newest days alone.

The index holds a row for each symbol and day: trades, first and last time, and
how many candles of each timeframe the day fills. From it follows, before any trade
is read, the first day that the newest so many candles of each symbol need; a
literal bound on the day prunes the folders, a bound on the time the row groups.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .market import TIMEFRAMES

DAY = 86_400
INDEX = "symbol string, n long, first_ts timestamp_ntz, last_ts timestamp_ntz, bars map<int,long>, day date"


def day_index(trades: DataFrame) -> DataFrame:
    """``symbol, day, n, first_ts, last_ts, bars`` of trades, of which it reads symbol
    and time alone; ``bars`` maps the seconds of each timeframe within a day to how
    many candles the day fills."""
    day = F.to_date("ts")
    within = [s for s in TIMEFRAMES.values() if s <= DAY]
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    minutes = trades.groupBy("symbol", day.alias("day"), slot.alias("slot")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    filled = F.create_map(*[x for s in within for x in (F.lit(s), F.count_distinct(F.floor(F.col("slot") / (s // 60))))])
    return minutes.groupBy("symbol", "day").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), filled.alias("bars"))


def first_day(index: DataFrame, seconds: int, limit: int | None = None, days: int | None = None) -> date | None:
    """The first day that holds a trade of the newest ``limit`` candles, or ``days``,
    of any symbol; None for no trades. Candles longer than a day begin on the days
    that their window does."""
    if days is not None:
        newest = index.groupBy("symbol").agg(F.max("last_ts").alias("newest"))
        return newest.agg(F.to_date(F.min("newest") - F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(seconds)))).first()[0]
    if seconds > DAY:
        start = F.to_date(F.window(F.col("day").cast("timestamp_ntz"), f"{seconds} seconds")["start"])
        counted = index.select("symbol", start.alias("day")).distinct().withColumn("held", F.lit(1))
    else:
        counted = index.select("symbol", "day", F.col("bars")[seconds].alias("held"))
    newer = F.sum("held").over(Window.partitionBy("symbol").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("newer", F.coalesce(newer, F.lit(0))).where(F.col("newer") < limit).agg(F.min("day")).first()[0]


@dataclass(frozen=True)
class Store:
    """Trades by day and bucket below ``path``, and their index."""

    spark: SparkSession
    path: str
    buckets: int = 16
    symbols: tuple[str, ...] = ()
    schema: T.StructType | None = None

    @property
    def trades(self) -> DataFrame:
        return self.since(None)

    @property
    def index(self) -> DataFrame:
        return self._of(self.spark.read.schema(INDEX).parquet(f"{self.path}/index"), False)

    def _of(self, rows: DataFrame, bucketed: bool) -> DataFrame:
        if not self.symbols:
            return rows
        rows = rows.where(F.col("symbol").isin(*self.symbols))
        return rows.where(F.col("bucket").isin(*self._buckets())) if bucketed else rows

    def _buckets(self) -> list[int]:
        named = self.spark.createDataFrame([(s,) for s in self.symbols], "symbol string")
        return sorted(r[0] for r in named.select(bucket_of(self.buckets)).distinct().collect())

    def only(self, *symbols: str) -> Store:
        return replace(self, symbols=symbols)

    def since(self, day: date | None) -> DataFrame:
        """The trades of ``day`` and after."""
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        rows = self._of(reader.parquet(f"{self.path}/trades"), True)
        return (rows if day is None else rows.where(F.col("day") >= F.lit(day))).drop("bucket", "day")

    def newest(self, seconds: int, limit: int | None = None, days: int | None = None) -> DataFrame:
        """The trades of the days that the newest candles of each symbol need."""
        return self.since(first_day(self.index, seconds, limit, days))


def bucket_of(buckets: int):
    return F.pmod(F.hash("symbol"), F.lit(buckets)).alias("bucket")


def save(trades: DataFrame, path: str, buckets: int = 16, parts: int = 4) -> Store:
    """Write trades below ``path``; the days that they hold are replaced there, others
    stay, so that writing a day again leaves no trade twice.

    A bucket of a day, which one symbol may fill, is dealt over ``parts`` tasks by time.
    """
    spark = trades.sparkSession
    placed = trades.withColumns({"day": F.to_date("ts"), "bucket": bucket_of(buckets)})
    part = F.floor(F.hour("ts") * parts / 24)
    dealt = placed.repartition("day", "bucket", part).sortWithinPartitions("day", "bucket", "symbol", "ts")
    _replace(dealt, f"{path}/trades", "day", "bucket")
    store = Store(spark, path, buckets, schema=placed.schema)
    written = spark.read.schema(placed.schema).parquet(f"{path}/trades")
    days = [r[0] for r in trades.select(F.to_date("ts").alias("day")).distinct().collect()]
    _replace(day_index(written.where(F.col("day").isin(days)).select("symbol", "ts")).repartition("day"), f"{path}/index", "day")
    return store


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    spark = rows.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

