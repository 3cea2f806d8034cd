import pytest
from helpers import bars, flat, indexed
from pyspark.sql import functions as F

from barlattice.operators import bars as B
from barlattice.operators import indicators as I


def values(df, column):
    return [r[0] for r in df.orderBy("bar_idx").select(column).collect()]


def test_true_range_and_atr(spark):
    b = indexed(spark, [(9, 10, 8, 9), (10, 12, 9, 11), (10, 11, 9, 10), (11, 13, 10, 12)])
    assert values(I.true_range(b), "tr") == [None, 3.0, 2.0, 3.0]
    assert values(I.atr(b, 3), "atr")[-1] == pytest.approx(8 / 3, abs=1e-6)
    assert values(I.atr_at_entry(b, 2), "atr_entry") == [2.0, 2.5, 2.5, 2.5]


def test_wilder_is_the_recursion(spark):
    rows = [(10, 10 + i % 5, 9 - i % 3, 10) for i in range(30)]
    b = indexed(spark, rows)
    trs = values(I.true_range(b, first_bar=True), "tr")
    at = sum(trs[:5]) / 5
    want = [at]
    for x in trs[5:]:
        at = (at * 4 + x) / 5
        want.append(at)
    got = [r.wilder for r in I.wilder_atr(b, 5).orderBy("bar_idx").collect()]
    assert got == pytest.approx(want, abs=1e-6)


def test_constant_series_has_no_correlation_and_no_width(spark):
    a, b = bars(spark, flat([10.0] * 30), symbol="A"), bars(spark, flat(range(1, 31)), symbol="B")
    assert I.correlations(a.union(b)).first().r == 0.0
    assert I.band_width(B.indexed(a)).agg(F.max("width")).first()[0] == 0.0


def test_perfect_correlation(spark):
    a, b = bars(spark, flat([1, 2, 4, 3, 5]), symbol="A"), bars(spark, flat([10, 20, 40, 30, 50]), symbol="B")
    assert I.correlations(a.union(b)).first().r == 1.0


def test_alignment_keeps_shared_times(spark):
    a = bars(spark, flat([10, 11, 12]), symbol="A", start="2024-01-01 01:00:00")
    b = bars(spark, flat([20, 21, 22]), symbol="B", start="2024-01-01 02:00:00")
    assert B.aligned(a.union(b), ["A", "B"]).count() == 2


def test_resample_breaks_ties_by_id(spark):
    rows = [("X", "2024-01-01 00:00:00", 2, 5.0, 1.0), ("X", "2024-01-01 00:00:00", 1, 4.0, 1.0), ("X", "2024-01-01 00:59:59", 3, 6.0, 1.0)]
    t = spark.createDataFrame(rows, "symbol string, ts string, trade_id long, price double, qty double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    r = B.resample(t, 3600).first()
    assert (r.open, r.high, r.low, r.close, r.volume) == (4.0, 6.0, 4.0, 6.0, 3.0)
    assert B.resample(t.limit(0), 3600).count() == 0
