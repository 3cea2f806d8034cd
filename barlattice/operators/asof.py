"""As-of join by one union and a scan in two levels: no range join, no per-row search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan as K


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], on: str, strict: bool = False, block: Column | None = None) -> DataFrame:
    """Rows of ``left`` with the newest row of ``right`` at or before ``on``
    (before it, with ``strict``). Both sides are dealt by ``by`` and ``block``, which
    ascends with ``on`` (of times the day, of numbers a span of them, if none is
    given); the last right row of the blocks before enters a block."""
    block = K.block_of(left, on) if block is None else block
    values = [c for c in right.columns if c not in (*by, on)]
    r = right.select(*by, on, F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("row"), F.struct(*values).alias("val"))
    l = left.select(*by, on, F.struct("*").alias("row"), F.lit(None).cast(r.schema["val"].dataType).alias("val"))
    side = F.col("val").isNotNull()
    both = l.unionByName(r).withColumn("turn", F.when(side, 1).otherwise(0) if strict else F.when(side, 0).otherwise(1))
    filled = K.carried(both, by, [F.col(on), F.col("turn")], block, {"val": F.col("val")}).where("row is not null")
    return filled.select("row.*", *[F.col(f"val.{c}").alias(c) for c in values])
