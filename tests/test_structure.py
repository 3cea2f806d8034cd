import random

from helpers import indexed
from pyspark.sql import functions as F

from barlattice.operators import structure as T


def walk(n, seed=1):
    rng, p, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o = p
        p = max(20.0, p + rng.choice([-3, -2, -1, 0, 1, 2, 3]))
        out.append((o, max(o, p) + rng.choice([0, 1, 2]), min(o, p) - rng.choice([0, 1, 2]), p))
    return out


def loop_pivots(rows, k):
    found = []
    for i in range(k, len(rows) - k):
        h, l = rows[i][1], rows[i][2]
        if all(rows[j][1] <= h for j in range(i - k, i)) and all(rows[j][1] < h for j in range(i + 1, i + k + 1)):
            found.append((i, "high", h))
        if all(rows[j][2] >= l for j in range(i - k, i)) and all(rows[j][2] > l for j in range(i + 1, i + k + 1)):
            found.append((i, "low", l))
    return found


def loop_breaks(rows, k, ahead=50):
    last, out, trend = {}, [], 0
    for i, side, price in loop_pivots(rows, k):
        last[side] = [price, i, False]
        for s, bias in (("high", 1), ("low", -1)):
            if s in last and not last[s][2]:
                for j in range(i + 1, min(i + ahead, len(rows))):
                    if (rows[j][3] - last[s][0]) * bias > 0:
                        last[s][2] = True
                        out.append(("CHoCH" if trend == -bias else "BOS", bias, last[s][0], last[s][1], j))
                        trend = bias
                        break
    return out


def test_pivots_and_breaks_match_a_loop(spark):
    for seed in (1, 2, 3):
        rows = walk(240, seed)
        s = T.of(indexed(spark, rows))
        assert sorted((r.i, r.side, r.price) for r in T.pivots(s, 3).collect()) == sorted(loop_pivots(rows, 3))
        got = [(r.type, r.bias, r.level, r.start_index, r.end_index) for r in T.breaks(s, 3).orderBy("ord").collect()]
        assert got == loop_breaks(rows, 3)


def test_pivots_mirror_under_negation(spark):
    rows = walk(150, 7)
    up = T.pivots(T.of(indexed(spark, rows)), 4)
    down = T.pivots(T.of(indexed(spark, [(-o + 500, -l + 500, -h + 500, -c + 500) for o, h, l, c in rows])), 4)
    assert {(r.i, r.side) for r in up.collect()} == {(r.i, "low" if r.side == "high" else "high") for r in down.collect()}


def test_gap_is_open_until_passed(spark):
    rows = [(10, 11, 9, 10), (12, 14, 11, 13), (15, 16, 13, 15)]
    assert T.gaps(T.of(indexed(spark, rows))).select("bias", "top", "bottom", "bar_index").first() == (1, 13.0, 11.0, 1)
    assert T.gaps(T.of(indexed(spark, rows + [(12, 13, 10.5, 12)]))).count() == 0


def test_series_do_not_mix(spark):
    rows = walk(120, 5)
    both = indexed(spark, rows, symbol="A").union(indexed(spark, walk(120, 6), symbol="B"))
    alone = T.structures(T.of(indexed(spark, rows, symbol="A")), 5, 3)
    assert alone.exceptAll(T.structures(T.of(both), 5, 3).where("symbol = 'A'")).count() == 0


def test_every_detector_takes_an_empty_series(spark):
    s = T.of(indexed(spark, walk(10)).limit(0))
    for df in (T.structures(s, 5, 3), T.gaps(s), T.order_blocks(s, 5, 3), T.equal_levels(s, 5), T.swing_labels(s, 5), T.fractals(s), T.liquidity_sweeps(s, 3), T.sweep_areas(s, 3), T.breaker_blocks(s, 5, 3), T.candle_trends(s, 3), T.trading_range(s, 5, 3)):
        assert df.agg(F.count("*")).first()[0] == 0
