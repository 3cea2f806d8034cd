"""Exact quantiles of large groups in bounded memory.

An exact percentile keeps all values of a group in one state. Here a first pass
takes a sketch of each group, whose rank error is proven (a share of ``1 / accuracy``
of the rows), and so a bracket of values around each wanted rank. A second pass
counts what lies below each bracket and groups the few values inside, from which
the two neighbours of the rank are picked and interpolated. Brackets go to the rows,
so that no task gets all rows of a group: they are sent to every task, or where there
are too many for that, met by the group and a salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written_once

#: Most brackets that are sent to every task; parts of a group beyond that.
SENT, SALTS = 500_000, 64


def exact(rows: DataFrame, by: list[str], value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """``by, n, quantiles``: of the values that are not null in each group, as an
    array in the order of ``shares``, interpolated between neighbouring ranks. Groups
    without values have no row; keys may be null."""
    known = rows.where(F.col(value).isNotNull()).select(F.struct(*by).alias("group"), F.col(value).cast("double").alias("x"))
    # Four times the sketch's error on either side, three ranks at least beyond it in a group of more than ``accuracy``.
    edge = 4.0 / accuracy
    ends = [max(0.0, s - edge) for s in shares] + [min(1.0, s + edge) for s in shares]
    sketch = known.groupBy("group").agg(
        F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", F.array(*[F.lit(e) for e in ends]), accuracy).alias("ends")
    )
    brackets = []
    for at, share in enumerate(shares):
        rank = F.lit(share) * (F.col("n") - 1)
        # A group of no more rows is one bracket; a rank near an end of its group is bracketed by that end.
        few = F.col("n") <= accuracy
        low = F.when(few | F.lit(share <= edge), F.col("least")).otherwise(F.get("ends", F.lit(at)))
        high = F.when(few | F.lit(share >= 1 - edge), F.col("most")).otherwise(F.get("ends", F.lit(len(shares) + at)))
        brackets.append(F.struct(F.lit(at).alias("at"), rank.alias("rank"), low.alias("low"), high.alias("high")))
    wanted = written_once(sketch.select("group", "n", F.array(*brackets).alias("brackets")), "brackets")
    met = _met(known, wanted.select("group", "brackets"), wanted.count() * len(shares) <= SENT).select("group", "x", "c", F.explode("brackets").alias("b")).where(F.col("x") <= F.col("b.high"))
    # Values below a bracket count together, as nulls, which sort first.
    inside = F.when(F.col("x") >= F.col("b.low"), F.col("x"))
    counts = met.groupBy("group", F.col("b.at").alias("at"), F.col("b.rank").alias("rank"), inside.alias("x")).agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("group", "at").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).where("x is not null")
    below, above = F.floor("rank"), F.ceil("rank")
    picked = placed.groupBy("group", "at", "rank").agg(F.min(F.when(F.col("upto") > below, F.col("x"))).alias("lo"), F.min(F.when(F.col("upto") > above, F.col("x"))).alias("hi"))
    value_at = F.when((below == above) | (F.col("lo") == F.col("hi")), F.col("lo")).otherwise((above - F.col("rank")) * F.col("lo") + (F.col("rank") - below) * F.col("hi"))
    out = picked.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("at", value_at.alias("v")))).alias("all"))
    return wanted.select("group", "n").join(out, "group").select("group.*", "n", F.transform("all", lambda s: s["v"]).alias("quantiles"))


def _met(rows: DataFrame, brackets: DataFrame, sent: bool) -> DataFrame:
    """``rows`` with the brackets of their group, and how many each stands for (``c``)."""
    if sent:
        return rows.withColumn("c", F.lit(1)).join(F.broadcast(brackets), "group")
    # Equal values count together first, so that none of them is a large part of its salt.
    dealt = rows.groupBy("group", "x").agg(F.count("*").alias("c")).withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int"))
    return dealt.join(brackets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["group", "salt"])
