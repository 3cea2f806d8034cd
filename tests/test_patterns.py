import pytest
from helpers import indexed

from barlattice.operators.candles import patterns


def keys(spark, rows):
    return {(r.key, r.direction) for r in patterns(indexed(spark, rows)).collect() if r.bar_idx == len(rows) - 1}


@pytest.mark.parametrize(
    ("rows", "found"),
    [
        ([(100, 105, 95, 100.1)], ("doji", "neutral")),
        ([(100, 110, 100, 110)], ("marubozu", "bullish")),
        ([(109, 110, 100, 110)], ("hammer", "bullish")),
        ([(101, 110, 100, 100)], ("shooting_star", "bearish")),
        ([(105, 106, 99, 100), (99, 107, 98, 106)], ("engulfing", "bullish")),
        ([(110, 111, 99, 100), (102, 105, 101, 104)], ("harami", "bullish")),
        ([(100, 110, 90, 105), (101, 108, 95, 104)], ("inside_bar", "neutral")),
        ([(100, 105, 95, 101), (100, 110, 90, 92)], ("outside_bar", "bearish")),
        ([(110, 111, 99, 100), (98, 99, 96, 98.2), (99, 109, 98, 108)], ("star", "bullish")),
        ([(100, 110, 99, 109), (105, 119, 104, 118), (112, 128, 111, 127)], ("three_soldiers_crows", "bullish")),
    ],
)
def test_pattern(spark, rows, found):
    assert found in keys(spark, rows)


def test_a_flat_bar_is_nothing(spark):
    assert keys(spark, [(100, 100, 100, 100)]) == set()
