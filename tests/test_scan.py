"""Scans and windows by block against plain loops, with blocks of any size."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlattice.operators import bars as B
from barlattice.operators import indicators as I
from barlattice.operators import outcomes as O
from barlattice.operators import profile as P
from barlattice.operators import quantiles
from barlattice.operators import scan as K
from barlattice.operators import structure as T
from barlattice.operators.asof import asof_join

from helpers import indexed


def rows_of(spark, n=157, seed=4):
    rng = random.Random(seed)
    data = [(s, i, rng.choice([None, float(rng.randrange(-9, 9))]), float(rng.randrange(-5, 6))) for s in "ab" for i in range(n if s == "a" else 3)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "s string, i int, x double, r double").repartition(5)


def series(data):
    out = {}
    for s, *rest in sorted(data, key=lambda d: d[:2]):
        out.setdefault(s, []).append(tuple(rest))
    return out


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_scans_equal_loops(spark, width):
    data, df = rows_of(spark)
    block = K.width_of("i", width)
    numbered = {(r.s, r.i): r.k for r in K.numbered(df.where("r <> 0"), ["s"], ["i"], block, "k").collect()}
    sums = {(r.s, r.i): r.c for r in K.running_sums(df, ["s"], ["i"], block, {"c": "r"}).collect()}
    held = {(r.s, r.i): r.v for r in K.carried(df, ["s"], [F.col("i")], block, {"v": F.col("x")}).collect()}
    prior = {(r.s, r.i): r.v for r in K.carried(df, ["s"], [F.col("i")], block, {"v": F.col("x")}, own=False).collect()}
    falls = {r.s: r.max_drawdown for r in K.worst_fall(df, ["s"], ["i"], block, "r").collect()}
    for s, rows in series(data).items():
        cum, peak, worst, last, k = 0.0, 0.0, 0.0, None, 0
        for i, x, r in rows:
            assert prior[s, i] == last
            last = x if x is not None else last
            cum += r
            peak = max(peak, cum)
            worst = max(worst, peak - cum)
            assert held[s, i] == last and sums[s, i] == cum
            if r != 0:
                assert numbered[s, i] == k
                k += 1
        assert falls[s] == worst


@pytest.mark.parametrize("width", [2, 5, 256])
def test_affine_recursion(spark, width):
    data, df = rows_of(spark)
    got = K.affine(df, ["s"], "i", F.lit(0.9), F.col("r"), "y", lambda x, row: x * 0.9 + row["v"], "r", width=width)
    got = {(r.s, r.i): r.y for r in got.collect()}
    for s, rows in series(data).items():
        y = 0.0
        for i, _, r in rows:
            y = y * 0.9 + r
            assert got[s, i] == pytest.approx(y, abs=1e-9)


@pytest.mark.parametrize("width", [3, 10, 1000])
def test_windows_with_a_halo(spark, width, monkeypatch):
    monkeypatch.setattr(K, "WIDTH", width)
    _, df = rows_of(spark)
    w = K.over_halo(["s"], "i")
    near = K.own(K.halo(df, 3, 2, "i", width).withColumn("y", F.sum("r").over(w.rowsBetween(-3, 2))))
    from pyspark.sql import Window

    plain = df.withColumn("y", F.sum("r").over(Window.partitionBy("s").orderBy("i").rowsBetween(-3, 2)))
    assert sorted(near.collect(), key=str) == sorted(plain.collect(), key=str)


def test_wilder_is_linear_and_in_many_tasks(spark):
    rng = random.Random(1)
    n, period = 3000, 14
    prices = [(p, p + 2.0, p - 1.0, p + 1.0) for p in (100 + rng.random() for _ in range(n))]
    got = {r.bar_idx: r.wilder for r in I.wilder_atr(indexed(spark, prices), period).collect()}
    trs = [prices[0][1] - prices[0][2]] + [max(h - l, abs(h - c), abs(l - c)) for (_, h, l, _), (_, _, _, c) in zip(prices[1:], prices)]
    at = sum(trs[:period]) / period
    for i in range(period - 1, n):
        at = at if i == period - 1 else (at * (period - 1) + trs[i]) / period
        assert got[i] == pytest.approx(at, abs=2e-6)
    assert len(got) == n - period + 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_over_a_whole_symbol(spark):
    b = indexed(spark, [(p, p + 1.0, p - 1.0, p) for p in range(60)])
    for df in (I.atr(b, 14), I.realized_vol(b, 30, 8760), I.band_width(b), T.pivots(T.of(b), 5), T.fractals(T.of(b)), T.later_extremes(T.of(b))):
        text = plan(df)
        windows = [line for line in text.splitlines() if "Window [" in line and ("min(" in line or "max(" in line or "avg(" in line or "stddev" in line or "lag(" in line)]
        assert windows and all("halo_block" in line or "scan_block" in line for line in windows)


def test_top_and_latest(spark):
    data, df = rows_of(spark)
    for n in (1, 4, 200):
        got = K.top(df, ["s"], [F.col("r").desc(), F.col("i")], F.pmod("i", F.lit(6)), n)
        want = {(s, i) for s, rows in series(data).items() for i, _, r in sorted(rows, key=lambda t: (-t[2], t[0]))[:n]}
        assert {(r.s, r.i) for r in got.collect()} == want
    bars = indexed(spark, [(p, p, p, p) for p in range(100)])
    assert sorted(r.bar_idx for r in B.latest(bars, 30).collect()) == list(range(70, 100))
    assert B.latest(bars, 1000).count() == 100
    assert "WindowGroupLimit" in plan(T.newest(T.pivots(T.of(bars), 3), T.of(bars), ["i"], 20))


def test_as_of_over_many_days(spark):
    t0 = datetime(2024, 1, 1)
    left = [("a", t0 + timedelta(hours=5 * h), h) for h in range(40)]
    right = [("a", t0 + timedelta(days=d, hours=2), d) for d in (1, 2, 6)] + [("b", t0, 9)]
    l, r = spark.createDataFrame(left, "k string, ts timestamp_ntz, h int"), spark.createDataFrame(right, "k string, ts timestamp_ntz, d int")
    got = {x.h: x.d for x in asof_join(l, r, by=["k"], on="ts").collect()}
    assert got == {h: max((d for k, at, d in right if k == "a" and at <= ts), default=None) for _, ts, h in left}


def test_first_bar_beyond_by_block_extremes(spark):
    rng = random.Random(9)
    prices = [(p, p + rng.random() * 3, p - rng.random() * 3, p + rng.random() - 0.5) for p in (100 + rng.random() * 4 for _ in range(900))]
    s = T.of(indexed(spark, prices))
    p = T.pivots(s, 5).select("symbol", "side", F.col("i").alias("pivot_index"), "price")
    got = {(r.side, r.pivot_index): r.x.i for r in T.first_beyond(p, s, ["side", "pivot_index", "price"], F.col("pivot_index") + 5, F.col("pivot_index") + 400, width=16).collect()}
    want = {}
    for r in p.collect():
        for i in range(r.pivot_index + 5, min(r.pivot_index + 401, len(prices))):
            _, h, l, c = prices[i]
            if (h > r.price if r.side == "high" else l < r.price) and c != r.price:
                want[r.side, r.pivot_index] = i
                break
    assert got == want and len(want) > 100


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(3)
    groups = {"even": rng.random(4001), "ties": rng.integers(0, 3, 3000).astype(float), "far": np.append(rng.random(2500), 1e12), "one": np.array([5.0]), None: rng.normal(size=1200)}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None), ("none", None)]
    shares = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: (r.n, r.quantiles) for r in quantiles.exact(spark.createDataFrame(data, "g string, x double").repartition(7), ["g"], "x", shares, accuracy).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert got[g][0] == len(xs)
        assert got[g][1] == pytest.approx([float(np.quantile(xs, s)) for s in shares], rel=1e-12)


@pytest.mark.parametrize("most", [500_000, 0])
def test_quantiles_of_a_large_group_stay_dealt_out(spark, monkeypatch, most):
    """No join brings all rows of a group together, whether brackets are sent or not."""
    monkeypatch.setattr(quantiles, "SENT", most, raising=False)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = spark.range(40_000, numPartitions=4).select(F.when(F.col("id") % 100 == 0, "small").otherwise("large").alias("g"), (F.col("id") * 7919 % 30_011).cast("double").alias("x"))
        out = quantiles.exact(data, ["g"], "x", [0.25, 0.5], 100)
        got = {r.g: (r.n, r.quantiles) for r in out.collect()}
        plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    for g in ("small", "large"):
        xs = [float(i * 7919 % 30_011) for i in range(40_000) if (i % 100 == 0) == (g == "small")]
        assert got[g] == (len(xs), pytest.approx([float(np.quantile(xs, s)) for s in (0.25, 0.5)], rel=1e-12))
    at = next(i for i, line in enumerate(plan) if "Generate explode(brackets" in line)
    join = next(line for line in plan[at:] if "Join" in line)
    assert "BroadcastHashJoin" in join or "salt#" in join


def test_profile_rows_by_a_sweep_line(spark):
    rng = random.Random(6)
    prices = [(p, p + rng.random() * 4, p - rng.random() * 4, p) for p in (50 + rng.random() * 9 for _ in range(70))]
    b = indexed(spark, prices).withColumn("day", F.lit("d"))
    rows = P.price_rows(b, ["symbol", "day"], letters=True).collect()
    for r in rows:
        touching = [k for k, (_, h, l, _) in enumerate(prices) if l < r.price + r.tick and h >= r.price]
        assert r["count"] == len(touching) == len(r.letters)
    assert "letter" not in plan(P.price_rows(b, ["symbol", "day"]))


def test_appended_bars_equal_a_full_run(spark):
    rng = random.Random(11)
    prices, at = [], 100.0
    for _ in range(700):
        at *= 1 + rng.uniform(-0.01, 0.01)
        prices.append((at, at * (1 + rng.random() / 100), at * (1 - rng.random() / 100), at * (1 + rng.uniform(-0.005, 0.005))))
    whole = indexed(spark, prices)
    full = {tuple(r.asDict()[c] for c in sorted(r.asDict())) for r in O.evaluated(whole).collect()}
    for n in (676, 460, 120):
        early = whole.where(F.col("bar_idx") < n)
        seen = early.groupBy("symbol").agg(F.count("*").alias("seen"))
        got = O.extended(O.evaluated(early), whole, seen).collect()
        assert len(got) == len(full) and {tuple(r.asDict()[c] for c in sorted(r.asDict())) for r in got} == full
        first = O.open_windows(seen).first().open_win
        assert n - first <= O.WINDOW + 48 + O.STEP


def test_footprints_read_trades_once(spark, tmp_path):
    from barlattice.operators import flow as W

    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(seconds=7 * k), k, 100.0 + (k * 37 % 11) / 10, 1.0 + k % 3, k % 2 == 0) for k in range(400)]
    spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, trade_id long, price double, qty double, is_buyer_maker boolean").write.parquet(str(tmp_path / "t"))
    levels = W.footprint_levels(spark.read.parquet(str(tmp_path / "t")), 300)
    assert plan(levels).count("FileScan") == 1
    got = {(str(r.bar_ts), r.level): (r.buy_vol, r.sell_vol, r.buy_count, r.sell_count) for r in levels.collect()}
    assert sum(v[0] + v[1] for v in got.values()) == sum(r[4] for r in rows) and sum(v[2] + v[3] for v in got.values()) == len(rows)
