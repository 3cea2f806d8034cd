"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node's neighbours are tied to the least of them.

    The least neighbour comes from a grouped minimum, which is combined before
    the shuffle, so that a hub costs no task of its own; the join back is one
    that skew handling can split.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``u, root`` for every node of ``edges(u long, v long)``, the root being
    the least node of its component. Loops and repeated edges do no harm; no
    edges give no rows."""
    state = written(edges.where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        step = _stars(state, large=True).where("u <> v").distinct()
        after = written(_stars(step, large=False).where("u <> v").distinct(), "edges")
        drop_written(state)
        state = after
        mark = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40)))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return state.select("u", F.col("v").alias("root")).union(state.select(F.col("v").alias("u"), F.col("v").alias("root"))).distinct()
