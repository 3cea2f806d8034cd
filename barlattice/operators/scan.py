"""Scans in two levels, and windows by block with a halo.

A running figure of a series needs all that came before; as a window over the
series it is one task. Here a series is cut into blocks, each block gives a
summary, the summaries are scanned (a row for each block), and what a block needs
from before it is joined to its rows, so that one hot series spreads over tasks.
Blocks are days where rows have a time only, since days are few whatever the
history, and ``WIDTH`` rows where rows are numbered.

A window that looks a bounded number of rows back or ahead needs no scan: each
block carries copies of its neighbours' nearest rows (:func:`halo`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block of numbered rows.
WIDTH = 1024

Fold = Callable[[Column, WindowSpec], Column]


def day_of(ts: str) -> Column:
    return F.date_trunc("day", ts)


def width_of(index: str, width: int = WIDTH) -> Column:
    return F.floor(F.col(index) / width)


def block_of(rows: DataFrame, column: str) -> Column | None:
    """Blocks along a column: days of times, spans of numbers; one block of all else."""
    kind = rows.schema[column].dataType
    return day_of(column) if isinstance(kind, T.DatetimeType) else width_of(column) if isinstance(kind, T.NumericType) else None


def with_entries(rows: DataFrame, by: list[str], block: Column | None, totals: dict[str, tuple[Column, Fold]], back: bool = False) -> DataFrame:
    """``rows`` with ``scan_block`` and, for each total, its fold over the blocks
    before (with ``back`` the blocks after); null where there are none.

    ``totals``: name to (aggregate of a block, fold of that column over a window).
    Without ``block``, for series of a bounded length, each is one block.
    """
    if block is None:
        kinds = rows.select(*[a.alias(name) for name, (a, _) in totals.items()]).schema
        return rows.withColumns({"scan_block": F.lit(0), **{f.name: F.lit(None).cast(f.dataType) for f in kinds}})
    dealt = rows.withColumn("scan_block", block)
    each = dealt.groupBy(*by, "scan_block").agg(*[a.alias(name) for name, (a, _) in totals.items()])
    order = F.col("scan_block").desc() if back else F.col("scan_block")
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    entries = each.select(*by, "scan_block", *[fold(F.col(name), w).alias(name) for name, (_, fold) in totals.items()])
    return dealt.join(entries, [*by, "scan_block"])


def inside(by: list[str], *order) -> WindowSpec:
    """A window over the rows of a block."""
    return Window.partitionBy(*by, "scan_block").orderBy(*order)


def numbered(rows: DataFrame, by: list[str], order: list, block: Column | None, name: str = "bar_idx") -> DataFrame:
    """``rows`` with their place from 0 in each series; ``block`` ascends with ``order``."""
    counted = with_entries(rows, by, block, {"scan_n": (F.count("*"), lambda c, w: F.sum(c).over(w))})
    at = F.row_number().over(inside(by, *order)) - 1 + F.coalesce("scan_n", F.lit(0))
    return counted.withColumn(name, at.cast("int")).drop("scan_n", "scan_block")


def running_sums(rows: DataFrame, by: list[str], order: list, block: Column | None, sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums: name of the sum to the column summed."""
    totals = {f"scan_{name}": (F.sum(value), lambda c, w: F.sum(c).over(w)) for name, value in sums.items()}
    w = inside(by, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = with_entries(rows, by, block, totals)
    return out.withColumns({name: F.sum(value).over(w) + F.coalesce(f"scan_{name}", F.lit(0)) for name, value in sums.items()}).drop("scan_block", *totals)


def carried(rows: DataFrame, by: list[str], order: list, block: Column | None, values: dict[str, Column], own: bool = True) -> DataFrame:
    """``rows`` with the newest value that is not null, at or before each row
    (before it, without ``own``)."""
    at = F.struct(*order)
    seen = rows.withColumns({f"seen_{name}": value for name, value in values.items()})
    totals = {f"scan_{name}": (F.max_by(f"seen_{name}", F.when(F.col(f"seen_{name}").isNotNull(), at)), lambda c, w: F.last(c, ignorenulls=True).over(w)) for name in values}
    w = inside(by, *order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = with_entries(seen, by, block, totals)
    return out.withColumns({name: F.coalesce(F.last(f"seen_{name}", ignorenulls=True).over(w), f"scan_{name}") for name in values}).drop("scan_block", *totals, *[f"seen_{n}" for n in values])


def worst_fall(rows: DataFrame, by: list[str], order: list, block: Column, value: str, name: str = "max_drawdown") -> DataFrame:
    """``by, name``: the largest fall of the running sum of ``value`` from its peak,
    zero at the start being a peak.

    A block is (sum, highest and lowest running sum, worst fall inside); before it
    stand the sum so far and the highest of the running sums.
    """
    w = inside(by, *order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("scan_block", block).withColumn("cum", F.sum(value).over(w))
    each = summed.withColumn("fall", F.max("cum").over(w) - F.col("cum")).groupBy(*by, "scan_block").agg(
        F.sum(value).alias("total"), F.max("cum").alias("high"), F.min("cum").alias("low"), F.max("fall").alias("fall")
    )
    before = Window.partitionBy(*by).orderBy("scan_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    peak = F.greatest(F.max(F.col("start") + F.col("high")).over(before), F.lit(0.0))
    return placed.withColumn("peak", peak).groupBy(*by).agg(F.max(F.greatest(F.col("fall"), F.col("peak") - F.col("start") - F.col("low"))).alias(name))


def affine(rows: DataFrame, by: list[str], index: str, a: Column, b: Column, name: str, step: Callable[[Column, Column], Column], value: str, width: int = 256, levels: int = 2) -> DataFrame:
    """``by, index, name``: x of ``x -> a * x + b`` in the order of ``index`` (from 0,
    each once), x being 0 before the first row.

    Maps compose: a block of ``width`` rows is one map, blocks of blocks are maps
    again, and what they give enters the blocks below. Only the topmost level is a
    single group, of a row for each ``width ** levels`` rows. Inside a block x goes
    on by ``step(x, row's value)``, the map as the caller writes it: rounded alike.
    """
    mapped = rows.select(*by, F.col(index).alias("k"), a.cast("double").alias("a"), b.cast("double").alias("b"), F.col(value).alias("v"))

    def scanned(maps: DataFrame, level: int) -> DataFrame:
        """``by, k, x``: x before the row ``k``, at the lowest level after it."""
        block = F.floor(F.col("k") / width) if level else F.lit(0)
        cells = F.array_sort(F.collect_list(F.struct(*[c for c in maps.columns if c not in by])))
        blocks = maps.groupBy(*by, block.alias("block")).agg(cells.alias("cells"))
        if level:
            whole = F.aggregate("cells", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda s, x: F.struct((s["a"] * x["a"]).alias("a"), (s["b"] * x["a"] + x["b"]).alias("b")))
            above = scanned(blocks.select(*by, F.col("block").alias("k"), whole.alias("m")).select(*by, "k", "m.*"), level - 1)
            blocks = blocks.join(above.select(*by, F.col("k").alias("block"), F.col("x").alias("enters")), [*by, "block"])
        else:
            blocks = blocks.withColumn("enters", F.lit(0.0))
        start = F.struct(F.col("enters").alias("x"), F.expr("cast(array() as array<double>)").alias("out"))
        lowest = level == levels
        onward = lambda s, c: step(s["x"], c) if lowest else s["x"] * c["a"] + c["b"]
        befores = F.aggregate("cells", start, lambda s, c: F.struct(onward(s, c).alias("x"), F.array_append(s["out"], onward(s, c) if lowest else s["x"]).alias("out")), lambda s: s["out"])
        return blocks.select(*by, F.explode(F.arrays_zip(F.col("cells"), befores.alias("befores"))).alias("z")).select(*by, "z.cells.*", F.col("z.befores").alias("x"))

    return scanned(mapped, levels).select(*by, F.col("k").alias(index), F.col("x").alias(name))


def halo(rows: DataFrame, before: int = 0, after: int = 0, index: str = "bar_idx", width: int = WIDTH) -> DataFrame:
    """``rows`` dealt to blocks of ``width`` in ``halo_block``, the last ``before`` rows
    of a block also to the next one and the first ``after`` to the one before; only
    in its own block is a row ``halo_own``."""
    width = max(width, before, after)
    block, place = F.floor(F.col(index) / width), F.col(index) % width
    blocks = [block, *([F.when(place >= width - before, block + 1)] if before else []), *([F.when((place < after) & (block > 0), block - 1)] if after else [])]
    return rows.withColumn("halo_block", F.explode(F.array_compact(F.array(*blocks)))).withColumn("halo_own", F.col("halo_block") == block)


def over_halo(by: list[str], index: str = "bar_idx") -> WindowSpec:
    return Window.partitionBy(*by, "halo_block").orderBy(index)


def own(rows: DataFrame) -> DataFrame:
    """The rows of :func:`halo` in their own blocks."""
    return rows.where("halo_own").drop("halo_block", "halo_own")


def top(rows: DataFrame, by: list[str], order: list[Column], block: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each series in ``order``: the first of each block, then
    of those, so that no task sorts a series."""
    best = Window.partitionBy(*by, "scan_block").orderBy(*order)
    few = rows.withColumn("scan_block", block).withColumn("scan_rank", F.row_number().over(best)).where(F.col("scan_rank") <= n).drop("scan_block")
    return few.withColumn("scan_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("scan_rank") <= n).drop("scan_rank")
