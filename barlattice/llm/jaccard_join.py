"""Exact n-gram Jaccard join by T-occurrence search.

Each document is the set of its distinct word n-grams, as 64-bit hashes. Two
documents with sets of a and b link when their overlap reaches
t * (a + b) / (1 + t); from a alone the overlap must reach T = ceil(t * a).

1. Prefixes. In the order of the hashes, the first a - T + l members of a set
   hold at least l of any T shared ones. Only these prefixes are counted across
   all documents; the members that occur more than once go to a bitmap of fixed
   size, and a document with too few such members links with nothing.
2. Pruning. The whole sets of what is left are counted the same way, and a set
   of which fewer than T members occur elsewhere goes, twice.
3. Families. With members in the order of their frequency, rarest first, sets
   that share a member of their prefixes fall into one family. Families share a
   task when small and are cut into blocks when large; every pair of blocks is
   then a task of its own, so no task holds more than two blocks.
4. Search. In a task, inverted lists are searched set by set with DivideSkip:
   the short lists are merged, counting occurrences; sets that could still reach
   T are probed by binary search in the long lists.
5. Components. Links become components, and documents of equal sets, which were
   one all along, take the component of their set.

A task returns a spanning forest of its links, so copies are never expanded into
pairs. Pairs of blocks are searched only where their sets are not yet in one
component.

A null text, or one without words, has an empty set and links with nothing. A
text with fewer words than n has one member, the whole sequence. Repeated rows
are copies. A null key gives a null component unless linked rows have keys.
Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import bitmap, probe
from .common import drop_written, join_hot, slices, small, written
from .components import components

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Texts to sorted arrays of 64-bit n-gram hashes."""

    def __init__(self, n: int):
        self.n = n
        self.known: dict[bytes, int] = {}

    def words(self, text: str) -> np.ndarray:
        known, out = self.known, []
        if len(known) > 250_000:
            known.clear()
        for w in text.encode("utf-8", "surrogatepass").lower().split():  # bytes: A-Z and ASCII white space alone
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words(text) if text else np.zeros(0, dtype=np.uint64)
        if not len(words):
            return words
        size = min(self.n, len(words))
        out = np.full(len(words) - size + 1, size, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out = (out ^ words[k : k + len(out)]) * _MIX
                out ^= out >> np.uint64(31)
        return np.unique(out)


def set_id(members: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)


def needed(size, t: Fraction):
    """Least overlap with any partner: ceil(t * size)."""
    return -(-size * t.numerator // t.denominator)


def reaches(overlap, a, b, t: Fraction):
    """overlap / (a + b - overlap) >= t, in whole numbers."""
    return overlap * (t.numerator + t.denominator) >= t.numerator * (a + b)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def search(sets: list[np.ndarray], side: np.ndarray, same: np.ndarray, t: Fraction, weight: float = 0.01) -> list[tuple[int, int]]:
    """DivideSkip over ``sets``: links that tie together what belongs together.

    ``side`` is 0 or 1 where only pairs across sides count, else all 0;
    ``same`` is the component known so far, pairs within one being skipped.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
    side, same = side[order], same[order]
    across = bool(side.any())
    members, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    owner = np.repeat(np.arange(len(order)), sizes)
    by_list = np.argsort(flat, kind="stable")
    postings = owner[by_list]  # of each member, its sets in rising order
    starts = np.searchsorted(flat[by_list], np.arange(len(members) + 1))
    at = np.concatenate(([0], np.cumsum(sizes)))
    forest, links = Forest(len(order)), []
    first: dict[int, int] = {}
    for i, c in enumerate(same.tolist()):
        if c in first:
            forest.join(first[c], i)
        first.setdefault(c, i)
    for q in range(len(order)):
        size = int(sizes[q])
        threshold = needed(size, t)  # partners before q are no larger
        lists = []
        for m in flat[at[q] : at[q + 1]].tolist():
            a, b = starts[m], starts[m + 1]
            if b - a > 1 and postings[a] < q:
                lists.append(postings[a:b])
        if len(lists) < threshold:
            continue
        lists.sort(key=len)
        longest = len(lists[-1])
        skip = min(threshold - 1, int(threshold / (weight * np.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
        ids, counts = merge(short)
        keep = (counts >= threshold - len(long)) & (ids < q) & (sizes[np.minimum(ids, q)] >= needed(size, t))
        if across:
            keep &= side[ids] != side[q]
        ids, counts = ids[keep], counts[keep]
        root = forest.root(q)
        if len(ids):
            fresh = np.array([forest.root(i) != root for i in ids.tolist()], dtype=bool)
            ids, counts = ids[fresh], counts[fresh]
        if not len(ids):
            continue
        for one in long:  # binary probes
            k = np.minimum(np.searchsorted(one, ids), len(one) - 1)
            counts += one[k] == ids
        for i in ids[reaches(counts, size, sizes[ids], t)].tolist():
            if forest.join(i, q):
                links.append((order[i], order[q]))
    return links


def merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their number of occurrences in rising lists: by a heap where the
    lists are few and short, else by one sort of them all."""
    total = sum(map(len, lists))
    if total <= 64:
        ids, counts = [], []
        for i in heapq.merge(*(one.tolist() for one in lists)):
            if ids and ids[-1] == i:
                counts[-1] += 1
            else:
                ids.append(i)
                counts.append(1)
        return np.array(ids, dtype=np.int64), np.array(counts, dtype=np.int64)
    return np.unique(np.concatenate(lists), return_counts=True)


def _longs(lists: list[np.ndarray]) -> pa.Array:
    """Arrow lists of the signed views of uint64 arrays."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def prefix_members(docs: DataFrame, n: int, t: Fraction) -> DataFrame:
    """``member`` for each member of each set's prefix; copies met by one task count once."""

    def run(batches: Iterator[pa.RecordBatch]):
        hasher, seen = Hasher(n), set()
        for batch in slices(batches, 0):
            out = []
            for text in batch.column(0).to_pylist():
                members = hasher(text)
                if len(members) and (own := set_id(members)) not in seen:
                    seen.add(own)
                    out.append(members[: prefix(len(members), t)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["member"])

    return docs.select("text").mapInArrow(run, "member long")


def slack(size: int, t: Fraction) -> int:
    return max(1, needed(size, t) // 8)


def prefix(size: int, t: Fraction) -> int:
    """Length of the prefix that holds the first ``size // 8`` (1 at least) shared members."""
    return min(size, size - needed(size, t) + max(1, size // 8))


def repeated(members: DataFrame) -> DataFrame:
    """Members that occur more than once."""
    return members.groupBy("member").agg(F.count("*").alias("df")).where("df > 1")


def rows_with_sets(docs: DataFrame, n: int, t: Fraction, power: int) -> DataFrame:
    """``key, n_shingles, set_id, members`` of every row; members are null where
    the prefix rules out any link, or where the same task has met the set before."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(repeated(prefix_members(docs, n, t)), "member", power))

    def run(batches: Iterator[pa.RecordBatch]):
        hasher, seen, known = Hasher(n), set(), bits.value
        for batch in slices(batches, 1):
            sizes, ids, full = [], [], []
            for text in batch.column(1).to_pylist():
                members = hasher(text)
                size, own = len(members), set_id(members)
                sizes.append(size)
                ids.append(own if size else None)
                kept = None
                if size and own not in seen:
                    seen.add(own)
                    if probe(known, members[: prefix(size, t)]).sum() >= slack(size, t):
                        kept = members.view(np.int64)
                full.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(full, pa.list_(pa.int64()))], names=["key", "n_shingles", "set_id", "members"]
            )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, n_shingles long, set_id long, members array<long>")


def pruned(sets: DataFrame, t: Fraction, power: int) -> DataFrame:
    """Sets of which at least T members occur in another set too."""
    bits = sets.sparkSession.sparkContext.broadcast(bitmap(repeated(sets.select(F.explode("members").alias("member"))), "member", power))

    def run(batches: Iterator[pa.RecordBatch]):
        known = bits.value
        for batch in batches:
            lists = batch.column(1)
            values, at = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)
            hits = np.concatenate(([0], np.cumsum(probe(known, values)))) if len(values) else np.zeros(1, dtype=np.int64)
            sizes = np.diff(at)
            yield batch.filter(pa.array(hits[at[1:]] - hits[at[:-1]] >= needed(sizes, t)))

    return sets.mapInArrow(run, sets.schema)


def families(sets: DataFrame, t: Fraction) -> DataFrame:
    """``set_id, family``: sets that share a member of their rarest-first prefixes."""
    each = sets.select("set_id", F.size("members").alias("size"), F.explode("members").alias("member"))
    shared = each.join(repeated(each.select("member")), "member")
    least = F.ceil(F.col("size") * t.numerator / F.lit(t.denominator))
    rarest = (
        shared.groupBy("set_id", "size")
        .agg(F.array_sort(F.collect_list(F.struct("df", "member"))).alias("known"))
        .withColumn("take", (F.size("known") - least + 1).cast("int"))
        .where("take > 0")
        .select("set_id", F.explode(F.slice("known", F.lit(1), F.col("take"))).alias("at"))
        .select("set_id", F.col("at.member").alias("member"))
    )
    rarest = written(rarest, "rarest")
    pivots = rarest.groupBy("member").agg(F.min("set_id").alias("pivot"))
    edges = rarest.join(pivots, "member").where("set_id <> pivot").select(F.col("set_id").alias("u"), F.col("pivot").alias("v")).distinct()
    found = components(edges).select(F.col("u").alias("set_id"), F.col("root").alias("family"))
    drop_written(rarest)
    return found


def links_within(groups: DataFrame, t: Fraction) -> DataFrame:
    """Search every group of ``task, side, same, set_id, members``: links ``u, v``."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("set_id").to_numpy()
        lists = table.column("members").combine_chunks()
        values, at = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)
        sets = [values[a:b] for a, b in zip(at[:-1], at[1:])]
        found = search(sets, table.column("side").to_numpy(), table.column("same").to_numpy(), t)
        return pa.table({"u": pa.array([ids[i] for i, _ in found], pa.int64()), "v": pa.array([ids[j] for _, j in found], pa.int64())})

    return groups.groupBy("task").applyInArrow(run, "u long, v long")


def link_sets(sets: DataFrame, t: Fraction, block: int) -> DataFrame:
    """Links ``u, v`` between sets that make up all components."""
    own = families(sets, t)
    placed = written(sets.join(own, "set_id"), "families")
    sizes = placed.groupBy("family").agg(F.sum(F.size("members")).alias("total"), F.count("*").alias("n"))
    cuts = F.ceil(F.col("total") / block).cast("int")
    placed = placed.join(sizes, "family").withColumn("cuts", cuts).withColumn("cut", F.pmod(F.xxhash64("set_id"), F.col("cuts")).cast("int"))
    total = sizes.agg(F.sum("total")).first()[0] or 0
    tasks = max(1, int(total // block) * 2 + 1)
    small = F.pmod(F.xxhash64("family"), F.lit(tasks))
    task = F.when(F.col("cuts") == 1, F.xxhash64(F.lit("small"), small)).otherwise(F.xxhash64("family", "cut"))
    zero = F.lit(0).cast("long")
    groups = placed.select(task.alias("task"), zero.alias("side"), F.col("set_id").alias("same"), "set_id", "members")
    found = written(links_within(groups, t), "links")
    large = placed.where("cuts > 1")
    if large.isEmpty():
        return found
    # blocks of large families: first one set of each component found, then whatever is still apart
    for heads_only in (True, False):
        roots = components(found).select(F.col("u").alias("set_id"), "root")
        known = large.join(roots, "set_id", "left").withColumn("same", F.coalesce("root", "set_id"))
        if heads_only:
            known = known.where("same = set_id")
        mixed = known.groupBy("family", "cut").agg(F.min("same").alias("least"), F.max("same").alias("most"))
        mixed = mixed.withColumn("part", F.struct("cut", "least", "most")).select("family", "part")
        pairs = (
            mixed.alias("a")
            .join(mixed.alias("b"), F.expr("a.family = b.family and a.part.cut < b.part.cut"))
            .where("not (a.part.least = a.part.most and b.part.least = b.part.most and a.part.least = b.part.least)")
            .select(F.col("a.family").alias("family"), F.col("a.part.cut").alias("i"), F.col("b.part.cut").alias("j"))
        )
        sided = pairs.select("family", F.xxhash64("family", "i", "j").alias("task"), F.explode(F.array(F.struct(F.col("i").alias("cut"), zero.alias("side")), F.struct(F.col("j").alias("cut"), F.lit(1).cast("long").alias("side")))).alias("x"))
        sided = sided.select("family", "task", F.col("x.cut").alias("cut"), F.col("x.side").alias("side"))
        more = links_within(known.join(sided, ["family", "cut"]).select("task", "side", "same", "set_id", "members"), t)
        found = written(found.union(more), "links")
    return found


def join(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, threshold: Fraction = Fraction(3, 4), power: int = 27, block: int = 1_500_000
) -> DataFrame:
    """Per row: ``key, n_shingles, component_id`` (the least key of its component).

    ``power``: the pruning bitmap has 2**power bits (16 MB for 27). ``block``:
    members that one block of a large family holds at most, about.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = written(rows_with_sets(rows, n, threshold, power), "rows")
    sets = written(rows.where("members is not null").select("set_id", "members").dropDuplicates(["set_id"]), "sets")
    for _ in range(2):
        fewer = written(pruned(sets, threshold, power), "sets")
        drop_written(sets)
        sets = fewer
    roots = components(link_sets(sets, threshold, block)).select(F.col("u").alias("set_id"), "root")
    classes = rows.where("set_id is not null").groupBy("set_id").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
    linked = written(classes.join(roots, "set_id"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_root = join_hot(linked.select("set_id", "root"), least, "root").select("set_id", "component_id")
    # a class outside all links is its own component
    by_set = classes.join(by_root, "set_id", "left").select("set_id", "copies", F.coalesce("component_id", "least").alias("component_id"))
    out = with_classes(rows.select("key", "n_shingles", "set_id"), by_set)
    return out.select(F.col("key").alias(key), "n_shingles", F.coalesce("component_id", "key").alias("component_id"))


def with_classes(rows: DataFrame, by_set: DataFrame, hot: int = 1000) -> DataFrame:
    """``rows(key, n_shingles, set_id)``, left joined with ``by_set(set_id, copies,
    component_id)``, which has a row per set.

    Sets of more than ``hot`` rows, or of a millionth of all rows if that is more,
    are sent to the rows: fewer than a million of them can exist (some 64 MB). The
    join by set then holds no hot key; rows that need none of it are spread over it.
    """
    most = max(hot, rows.count() // 1_000_000)
    sent = F.broadcast(by_set.where(F.col("copies") > most).select("set_id", F.col("component_id").alias("sent"), F.lit(True).alias("is_sent")))
    marked = rows.join(sent, "set_id", "left").withColumn("asks", F.col("is_sent").isNull() & F.col("set_id").isNotNull())
    marked = marked.withColumn("at", F.when(F.col("asks"), F.col("set_id")).otherwise(F.xxhash64("key", F.monotonically_increasing_id())))
    rest = by_set.where(F.col("copies") <= most).select(F.col("set_id").alias("at"), F.lit(True).alias("asks"), "component_id")
    return marked.join(rest, ["at", "asks"], "left").select("key", "n_shingles", F.coalesce("sent", "component_id").alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each component
    the row of its least key stays, and of repeated keys and texts the one whose
    other columns hash least (rows that are wholly equal are one)."""
    groups = join(docs, key=key, text=text, **options)
    kept = written(groups.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("kept_key")).distinct(), "kept")
    left = docs.join(small(kept), docs[key].eqNullSafe(kept["kept_key"]), "left_semi")
    if left.groupBy(key).count().where("count > 1").isEmpty():
        return left
    others = [f.name for f in docs.schema if f.name not in (key, text) and not f.dataType.simpleString().startswith(("map", "variant"))]
    first = F.row_number().over(Window.partitionBy(key, F.xxhash64(text)).orderBy(F.xxhash64(*others) if others else F.lit(0)))
    return left.withColumn("keep_one_rank", first).where("keep_one_rank = 1").drop("keep_one_rank")
