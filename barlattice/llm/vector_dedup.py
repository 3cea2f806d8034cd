"""Embedding near-duplicates by sorted projection passes.

Every pass draws random directions; the signs of a vector's projections,
concatenated, are its hash, and vectors are ordered by it. Each vector is
compared with its next ``window`` neighbours in that order, in double precision,
and verified pairs of all passes are united to components. Equal vectors are one
class from the start. Within a component the links are then counted exactly, in
blocks, so a window's bound limits the search and not the result.

The number of passes grows with the number of vectors, so that among evenly
spread vectors a pair at the threshold is met with the chance ``recall`` at any
size. In dense regions a window holds a smaller part of what is near; so more
passes follow, with wider windows, until what the last ones united and how fast
that falls say that no more than ``1 - recall`` of the components is still to come.

The order of a pass is dealt in parts of ``per_part`` vectors, whatever the
cluster; the last vectors of a part are compared with the first of the next, so
that borders lose nothing while a part holds more than a window.

Null and zero vectors, and vectors with null or non-finite components, link with
nothing; neither do vectors of different lengths or rows of a null key. Repeated
rows are copies. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written
from .components import components


def unit(lists: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length 1, in double precision."""
    flat = np.asarray(lists.values, dtype=np.float64)
    at = np.asarray(lists.offsets)
    x = flat[at[0] : at[-1]].reshape(len(lists), -1)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """All rows with their class or null, and one row per class of equal vectors."""
    x = F.col(vector)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    vector_or_null = F.when(sound, F.transform(x, lambda v: v + F.lit(0).cast("float")))
    rows = vectors.select(F.col(key).alias("key"), vector_or_null.alias("x")).withColumn("class", F.when(F.col("x").isNotNull() & F.col("key").isNotNull(), F.xxhash64("x")))
    one = rows.where("class is not null").groupBy("class").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.first("x").alias("x"))
    return rows, one


def pass_count(n: int, window: int, cosine: float, recall: float) -> int:
    """Passes after which a pair at the threshold has met with chance ``recall``:
    it shares the bits that narrow n vectors down to a window."""
    bits = max(1.0, math.log2(max(2.0, 4 * n / window)))
    chance = (1 - math.acos(cosine) / math.pi) ** bits
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


def candidates(one: DataFrame, n: int, cosine: float, window: int, recall: float, at_once: int, seed: int, per_part: int) -> DataFrame:
    """``u, root`` of the classes that are linked, by as many passes as it takes."""
    total = pass_count(n, window, cosine, recall)
    links = None
    for first in range(0, total, at_once):
        more = passes_over(one, n, list(range(first, min(total, first + at_once))), cosine, window, seed, per_part)
        links = more if links is None else links.union(more)
    wide, united, gain = window, None, None
    while True:
        roots = written(components(links), "roots")
        members, groups = roots.agg(F.count("*"), F.count_distinct("root")).first()
        if united is not None:
            last, gain = gain, members - groups - united
            if not gain or (last and gain < last and gain * gain / (last - gain) <= (1 - recall) * groups):
                return roots
            wide = min(2 * wide, 16 * window)
        united = members - groups
        forest = roots.where("u != root").select("u", F.col("root").alias("v"))
        links = forest.union(passes_over(one, n, list(range(total, total + at_once)), cosine, wide, seed, per_part))
        total += at_once


class Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, c: int) -> int:
        up = self.up
        while up.setdefault(c, c) != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def passes_over(one: DataFrame, n: int, passes: list[int], cosine: float, window: int, seed: int, per_part: int = 20_000, bits: int = 60) -> DataFrame:
    """Links ``u, v`` between classes found by these passes: a forest per task."""

    def hashed(batches):
        for batch in batches:
            for size in {len(v) for v in batch.column(1)}:
                own = batch.filter(pa.array([len(v) == size for v in batch.column(1)]))
                x = unit(own.column(1))
                for p in passes:
                    directions = np.random.default_rng([seed, p, size]).standard_normal((size, bits))
                    signs = x @ directions > 0
                    order = (signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), p, dtype=np.int32)), pa.array(np.full(len(x), size, dtype=np.int32)), pa.array(order), own.column(0), own.column(1)],
                        names=["pass", "size", "hash", "class", "x"],
                    )

    kind = one.schema["x"].dataType.simpleString()
    keyed = one.select("class", "x").mapInArrow(hashed, f"pass int, size int, hash long, class long, x {kind}")
    parts = max(1, math.ceil(n * len(passes) / per_part))
    ordered = keyed.repartitionByRange(parts, "pass", "size", "hash", "class").sortWithinPartitions("pass", "size", "hash", "class")
    at_border = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("border", pa.int64()), ("lower", pa.bool_()), ("group", pa.int64()), ("place", pa.int32()), ("x", pa.list_(pa.float32() if "float" in kind else pa.float64()))])

    def groups_of(batch):
        return np.asarray(batch.column(0)).astype(np.int64) * (1 << 32) + np.asarray(batch.column(1))

    def edge(rows: list, border: int, lower: bool):
        """The rows at one end of a part, numbered from the border on."""
        table = pa.Table.from_batches(rows).combine_chunks()
        size = table.num_rows
        place = np.arange(size, 0, -1) if lower else np.arange(size)
        none = pa.nulls(size, pa.int64())
        columns = [table.column(3).combine_chunks(), none, np.full(size, border), np.full(size, lower), groups_of(table), place.astype(np.int32), table.column(4).combine_chunks().cast(at_border.field("x").type)]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, at_border)], schema=at_border)

    def compare(batches):
        part = TaskContext.get().partitionId()
        tail: list | None = None
        forest = Forest()
        head, end, seen = [], [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if seen < window:
                head.append(batch.slice(0, window - seen))
            seen += batch.num_rows
            end.append(batch.slice(max(0, batch.num_rows - window)))
            while sum(b.num_rows for b in end[1:]) >= window:
                end.pop(0)
            groups, ids = groups_of(batch), np.asarray(batch.column(3))
            for g in np.unique(groups):
                where = np.flatnonzero(groups == g)
                x, own = unit(batch.column(4).slice(where[0], len(where))), ids[where]
                if tail and tail[0] == g:
                    x, own = np.concatenate([tail[1], x]), np.concatenate([tail[2], own])
                u, v = [], []
                for d in range(1, min(window, len(x) - 1) + 1):
                    for i in np.flatnonzero(np.einsum("ij,ij->i", x[:-d], x[d:]) >= cosine):
                        if forest.join(int(own[i]), int(own[i + d])):
                            u.append(int(own[i]))
                            v.append(int(own[i + d]))
                tail = [g, x[-window:], own[-window:]]
                if u:
                    rest = [pa.nulls(len(u), f.type) for f in list(at_border)[2:]]
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), *rest], schema=at_border)
        if seen:
            if part:
                yield edge(head, part - 1, False)
            last = pa.Table.from_batches(end)
            yield edge(last.slice(max(0, last.num_rows - window)).to_batches(), part, True)

    def across(table: pa.Table) -> pa.Table:
        lower, group, place = (np.asarray(table.column(c).to_pylist()) for c in ("lower", "group", "place"))
        ids, lists = table.column("u").to_numpy(), table.column("x").combine_chunks()
        forest, u, v = Forest(), [], []
        for g in np.unique(group):
            a, b = np.flatnonzero(lower & (group == g)), np.flatnonzero(~lower & (group == g))
            if len(a) and len(b):
                near = unit(lists.take(pa.array(a))) @ unit(lists.take(pa.array(b))).T >= cosine
                for i, j in zip(*np.nonzero(near & (place[a][:, None] + place[b][None, :] <= window))):
                    if forest.join(int(ids[a[i]]), int(ids[b[j]])):
                        u.append(int(ids[a[i]]))
                        v.append(int(ids[b[j]]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    found = written(ordered.mapInArrow(compare, f"u long, v long, border long, lower boolean, group long, place int, x {kind}"), "links")
    inner = found.where("border is null").select("u", "v")
    return inner.union(found.where("border is not null").groupBy("border").applyInArrow(across, "u long, v long"))


def counted(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """``class, links``: copies of other classes of one component within reach.

    A component is cut into blocks; each pair of blocks is a task that holds two
    blocks and returns counts, never pairs. Small components share tasks.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, int(total // block) * 2 + 1)
    placed = join_hot(members, sizes, "root").withColumn("cuts", F.ceil(F.col("n") / block).cast("int"))
    placed = placed.withColumn("cut", F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda j: F.struct(F.xxhash64("root", F.least("cut", j), F.greatest("cut", j)).alias("task"), (F.col("cut") > j).alias("upper")),
    )
    alone = F.array(F.struct(F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("root"), F.lit(tasks))).alias("task"), F.lit(False).alias("upper")))
    dealt = placed.select("class", "root", "copies", "x", F.explode(F.when(F.col("cuts") == 1, alone).otherwise(others)).alias("t"))
    dealt = dealt.select("t.task", F.col("t.upper").alias("upper"), "class", "root", "copies", "x")

    def run(table: pa.Table) -> pa.Table:
        roots, ids = table.column("root").to_numpy(), table.column("class").to_numpy()
        copies, upper = table.column("copies").to_numpy(), np.asarray(table.column("upper").to_pylist(), dtype=bool)
        lists = table.column("x").combine_chunks()
        order = np.argsort(roots, kind="stable")
        out = np.zeros(len(ids), dtype=np.int64)
        for own in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            x = unit(lists.take(pa.array(own)))
            high = upper[own]
            a, b = np.flatnonzero(~high), np.flatnonzero(high)
            for at in range(0, len(a), 512):
                rows = a[at : at + 512]
                if len(b):
                    near = x[rows] @ x[b].T >= cosine
                    out[own[rows]] += near @ copies[own[b]]
                    out[own[b]] += near.T @ copies[own[rows]]
                else:
                    near = x[rows] @ x[a].T >= cosine
                    near[np.arange(len(rows)), np.arange(at, at + len(rows))] = False
                    out[own[rows]] += near @ copies[own[a]]
        return pa.table({"class": pa.array(ids), "links": pa.array(out)})

    return dealt.groupBy("task").applyInArrow(run, "class long, links long").groupBy("class").agg(F.sum("links").alias("links"))


def dedup(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    cosine: float = 0.9,
    window: int = 40,
    recall: float = 0.99,
    at_once: int = 8,
    block: int = 4096,
    seed: int = 20240229,
    per_part: int = 20_000,
) -> DataFrame:
    """Per row: ``key, n_links, component_id, kept``."""
    rows, one = classes(vectors, key, vector)
    rows, one = written(rows.select("key", "class"), "rows"), written(one, "classes")
    n = one.count()
    roots = candidates(one, n, cosine, window, recall, at_once, seed, per_part).withColumnRenamed("u", "class")
    members = written(one.join(roots, "class"), "members")
    links = counted(members, cosine, block)
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = join_hot(members.select("class", "root"), least, "root").join(links, "class", "left").select("class", "links", "component_id")
    tied = one.select("class", "copies", "least").join(linked, "class", "left")
    by_class = tied.select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(by_class, "class", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "key").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
