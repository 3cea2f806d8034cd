import os

import pytest
from pyspark.sql import functions as F

from barlattice.api import Market
from barlattice.sources import market as M

SF = "/root/testdata/sf0.001"


def test_timeframes():
    assert M.normalize_timeframe("H4") == "4h"
    with pytest.raises(ValueError):
        M.normalize_timeframe("7m")


def test_klines(spark):
    raw = spark.createDataFrame([('[1700000000000, "1.5", "2", "1", "1.7", "3", 0]',)], "payload string")
    r = M.parse_klines(raw).first()
    assert (r.open, r.high, r.low, r.close, r.volume) == (1.5, 2.0, 1.0, 1.7, 3.0) and str(r.bar_ts) == "2023-11-14 22:13:20"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_endpoints(spark):
    m = Market(M.ticks(spark, SF)).only("click", "view")
    assert m.get_candles("1h", 5).count() == 10
    assert m.get_levels().count() > 0
    assert set(m.get_price_action("1h")) == {"patterns", "summary"}
    assert set(m.compute_orb_stats()) == {"days", "breakouts", "extension", "day_of_week"} and m.get_daily_bias()["statistics"].count() == 2
    with pytest.raises(ValueError):
        m.get_orderflow("4h")
    with pytest.raises(ValueError):
        m.get_session_card("nowhere")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stream_equals_batch(spark, tmp_path):
    from barlattice.operators.bars import resample
    from barlattice.streaming.bars import stream_bars

    ticks = M.ticks(spark, SF)
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    q = stream_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars_stream").start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.table("bars_stream"), resample(ticks, 3600)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_entry_lists_sql_for_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 90 and F is not None
