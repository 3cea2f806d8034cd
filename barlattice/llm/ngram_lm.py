"""Interpolated modified Kneser-Ney models over the characters of words.

A text is its words; each word's characters, and its end, are predicted from up
to ``order - 1`` characters before them in the word. Such n-grams saturate as a
corpus grows, while their counts take in every word of it.

Counting is one pass: tasks count words, turn distinct words into n-grams, and
send one row per n-gram. The lower orders' continuation counts, the discounts,
the sums of contexts and the interpolated probabilities are grouped and joined
by n-gram, dealt over the shuffle's partitions. The finished model is broadcast
up to ``MODEL_GRAMS`` rows; a larger one scores the distinct words of the corpus
by joins (:func:`score_by_join`), with the same result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

START, END = "\x02", "\x03"
MODEL_GRAMS = 20_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def codes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points before and at each predicted character, one row each, and the
    number of predictions of each word."""
    text = "".join([START * (order - 1) + w + END for w in words]).replace("\x00", "\x01")
    flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    ends = np.cumsum(lengths + order - 1)
    starts = ends - lengths - (order - 1)
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(int(lengths.sum()))
    return flat[at[:, None] + np.arange(order)], lengths


def hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points."""
    out = np.full(len(rows), rows.shape[1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            out = (out ^ rows[:, k].astype(np.uint64)) * _MIX
            out ^= out >> np.uint64(29)
    return out


def strings(rows: np.ndarray) -> list[str]:
    flat = rows.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    n = rows.shape[1]
    return [flat[i : i + n] for i in range(0, len(flat), n)]


def count_grams(rows: DataFrame, order: int, *, flush: int = 400_000) -> DataFrame:
    """``gram, chosen, total`` over ``rows(text, chosen boolean)``: counts in the
    chosen rows and in all. Lone surrogates count as the replacement mark."""

    def run(batches):
        words: tuple[Counter, Counter] = (Counter(), Counter())

        def send():
            total = words[0] + words[1]
            if not total:
                return None
            names = list(total)
            table, lengths = codes(names, order)
            keys = hashes(table)
            _, first, back = np.unique(keys, return_index=True, return_inverse=True)
            sums = [np.bincount(back, weights=np.repeat(np.array([c[w] for w in names], dtype=np.float64), lengths)) for c in (words[1], total)]
            for c in words:
                c.clear()
            texts = [s.encode("utf-8", "replace").decode() for s in strings(table[first])]
            return pa.RecordBatch.from_arrays([pa.array(texts), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64))], names=["gram", "chosen", "total"])

        for batch in slices(batches, 0):
            for text, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    words[bool(chosen)].update(text.split())
            if len(words[0]) + len(words[1]) > flush:
                yield send()
        if (last := send()) is not None:
            yield last

    counted = rows.select("text", "chosen").mapInArrow(run, "gram string, chosen long, total long")
    return counted.groupBy("gram").agg(F.sum("chosen").alias("chosen"), F.sum("total").alias("total"))


@dataclass
class Tables:
    """A model as frames: ``probs`` (gram, p) and ``backs`` (context, back) of
    all orders, told apart by their length; ``floor`` for unseen characters."""

    order: int
    probs: DataFrame
    backs: DataFrame
    floor: float


def discounts(counts: list[int]) -> list[float]:
    """Discounts of 1, 2 and 3 or more from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (max(c, 1) for c in counts)
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def train(grams: DataFrame, count: str, order: int, characters: int) -> Tables | None:
    """Kneser-Ney tables from the counts in column ``count`` of :func:`count_grams`;
    ``characters`` is the size of the shared inventory. None without any count."""
    level = written(grams.where(F.col(count) > 0).select("gram", F.col(count).alias("c")), "level")
    levels = [level]
    for _ in range(order - 1):
        level = level.groupBy(F.substr("gram", F.lit(2)).alias("gram")).agg(F.count("*").alias("c"))
        levels.append(level)
    probs = backs = below = None
    floor = 1.0 / (characters + 1)
    for n, level in zip(range(1, order + 1), reversed(levels)):
        level = written(level, "level")
        ones = level.agg(*[F.count(F.when(F.col("c") == k, 1)) for k in range(1, 5)], F.count("*")).first()
        if not ones[4]:
            return None
        d = discounts(ones[:4])
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        split = level.select("gram", F.substr("gram", F.lit(1), F.lit(n - 1)).alias("context"), F.substr("gram", F.lit(2)).alias("rest"), "c", cut.alias("cut"))
        sums = split.groupBy("context").agg(F.sum("c").alias("sum"), *[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2)], F.count("*").alias("n"))
        back = (d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * (F.col("n") - F.col("n1") - F.col("n2"))) / F.col("sum")
        sums = sums.select("context", "sum", back.alias("back"))
        joined = split.join(sums, "context")
        lower = F.lit(floor) if below is None else F.col("lower")
        if below is not None:
            joined = joined.join(below.select(F.col("gram").alias("rest"), F.col("p").alias("lower")), "rest")
        below = written(joined.select("gram", ((F.col("c") - F.col("cut")) / F.col("sum") + F.col("back") * lower).alias("p")), "probs")
        probs = below if probs is None else probs.union(below)
        own = sums.select("context", "back")
        backs = own if backs is None else backs.union(own)
    return Tables(order, probs, written(backs, "backs"), floor)


class Model:
    """The tables as sorted arrays of hashes, by order."""

    def __init__(self, tables: Tables):
        self.order, self.floor = tables.order, tables.floor
        self.probs = self._arrays(tables.probs.toArrow(), range(1, self.order + 1))
        self.backs = self._arrays(tables.backs.toArrow(), range(self.order))
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    @staticmethod
    def _arrays(table: pa.Table, sizes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        names, values = table.column(0).to_pylist(), table.column(1).to_numpy()
        by: dict[int, list[int]] = {n: [] for n in sizes}
        for i, name in enumerate(names):
            by[len(name)].append(i)
        out = {}
        for n, at in by.items():
            flat = np.frombuffer("".join([names[i] for i in at]).encode("utf-32-le"), dtype=np.uint32).reshape(len(at), n)
            keys = hashes(flat)
            order = np.argsort(keys)
            out[n] = keys[order], np.log(values[at][order])
        return out

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, values = table
        if not len(known):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return hit, np.where(hit, values[at], 0.0)

    def losses(self, words: list[str]) -> np.ndarray:
        """Negative log probability of each word and its end."""
        rows, lengths = codes([w.encode("utf-8", "replace").decode() for w in words], self.order)
        total = np.full(len(rows), 0.0)
        open_ = np.arange(len(rows))
        for n in range(self.order, 0, -1):
            part = rows[open_][:, self.order - n :]
            hit, value = self._find(self.probs[n], hashes(part))
            total[open_[hit]] += value[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
            total[open_] += self._find(self.backs[n - 1], hashes(part[~hit][:, :-1]))[1]
        total[open_] += np.log(self.floor)
        return -np.add.reduceat(total, np.concatenate(([0], np.cumsum(lengths)[:-1])))

    def learn(self, texts: list[list[str]]) -> None:
        """Score the words not met before."""
        if len(self.known) > 400_000:
            self.known.clear()
        new = list({w for t in texts for w in t} - self.known.keys())
        for at in range(0, len(new), 100_000):
            part = new[at : at + 100_000]
            self.known.update(zip(part, self.losses(part).tolist()))


def score(docs: DataFrame, models: list[Tables], *, extra: tuple[str, ...] = (), most: int = MODEL_GRAMS) -> DataFrame:
    """``docs`` is ``text`` and ``extra`` columns. Per row: the extra columns,
    ``n_words, n_tokens`` (characters and word ends) and ``losses``, one sum per model."""
    size = max(m.probs.count() + m.backs.count() for m in models)
    if size > most:
        return score_by_join(docs, models, extra=extra)
    sent = [docs.sparkSession.sparkContext.broadcast(Model(m)) for m in models]
    rows = docs.select(*extra, "text")
    place = len(extra)

    def run(batches):
        own = [s.value for s in sent]
        for batch in slices(batches, place):
            texts = [t.split() if t else [] for t in batch.column(place).to_pylist()]
            sums = []
            for m in own:
                m.learn(texts)
                known = m.known
                sums.append([sum([known[w] for w in t]) for t in texts])
            tokens = [sum(map(len, t)) + len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:place], pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([list(s) for s in zip(*sums)], pa.list_(pa.float64()))],
                names=[*extra, "n_words", "n_tokens", "losses"],
            )

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in extra)
    return rows.mapInArrow(run, f"{kinds}{', ' if extra else ''}n_words long, n_tokens long, losses array<double>")


def score_by_join(docs: DataFrame, models: list[Tables], *, extra: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`score`, for models of any size: the distinct words of all texts
    are scored by joins with the tables, and texts joined with their words."""
    space = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    rows = written(docs.select(*extra, F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id()), "rows")
    words = F.filter(F.split("text", space), lambda w: w != "")
    each = written(rows.select("row", F.explode(words).alias("word")).groupBy("row", "word").agg(F.count("*").alias("n")), "words")
    vocabulary = written(each.select("word").distinct(), "vocabulary")
    losses = vocabulary
    for k, m in enumerate(models):
        padded = F.concat(F.lit(START * (m.order - 1)), F.regexp_replace("word", "\x00", "\x01"), F.lit(END))
        grams = vocabulary.select("word", padded.alias("padded")).select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("padded") - m.order + 1), lambda i: F.substr("padded", i, F.lit(m.order)))).alias("g"))
        loss = F.lit(float(np.log(m.floor)))
        for n in range(1, m.order + 1):
            own = F.substr("g", F.lit(m.order - n + 1))
            grams = grams.withColumn("own", own).join(m.probs.select(F.col("gram").alias("own"), F.log("p").alias(f"p{n}")), "own", "left").drop("own")
            grams = grams.withColumn("own", F.substr("g", F.lit(m.order - n + 1), F.lit(n - 1))).join(m.backs.select(F.col("context").alias("own"), F.log("back").alias(f"b{n}")), "own", "left").drop("own")
            loss = F.coalesce(F.col(f"p{n}"), F.coalesce(F.col(f"b{n}"), F.lit(0.0)) + loss)
        losses = losses.join(grams.groupBy("word").agg((-F.sum(loss)).alias(f"loss{k}")), "word")
    sums = [F.sum(F.col("n") * F.col(f"loss{k}")) for k in range(len(models))]
    scored = each.join(losses, "word").groupBy("row").agg(F.sum("n").alias("n_words"), F.sum(F.col("n") * (F.length("word") + 1)).alias("n_tokens"), F.array(*sums).alias("losses"))
    none = F.array(*[F.lit(0.0) for _ in models])
    out = rows.join(scored, "row", "left")
    return out.select(*extra, F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("losses", none).alias("losses"))
