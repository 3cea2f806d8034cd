"""Interpolated modified Kneser-Ney models over words, across the words of a text.

A text is its words and its end; each is predicted from up to ``order - 1`` words
before it, from the text's start on. Every n-gram of every text is counted, so
the tables grow with the corpus; none is pruned, capped or sampled. Words go by
64-bit hashes, n-grams by hashes of those.

Tokens are dealt into buckets of about ``BUCKET`` by the word before the predicted
one, so that a bucket has all n-grams of two words and more that it needs, with
their contexts. A word before so many tokens that they fill a good part of a bucket
is dealt by the word before it too; its n-grams of two words are summed over
buckets. Buckets are met twice, once for the counts of counts and of single words,
once for the losses, a slice of them at a time: no more than a slice's tokens are
on disk at once. Nothing of the model goes to the driver or to one task but counts
of counts and the list of those frequent words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, shuffles_dropped, slices, written
from .ngram_lm import discounts

#: What stands for a text's start and its end.
START, END = 0, 1

#: Tokens of a bucket; rows (of texts) whose losses are summed in one step, as a power of two.
BUCKET, TOGETHER = 1 << 20, 12

#: Tokens that close a step: those of a step share a list of words, and are dealt out together.
STEP = 1 << 22

#: What a step is stored as: its first row, its distinct words by falling frequency, the place of each token's
#: word among them, and for each row twice its tokens, plus one if chosen.
STEPS = "base long, n long, size long, known binary, ids binary, texts long, lengths binary"


def packed(x: np.ndarray) -> bytes:
    """Bytes of numbers, first all lowest ones and so on, compressed."""
    return pa.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * kind.itemsize, codec="zstd"), dtype=np.uint8).reshape(kind.itemsize, n).T).view(kind)[:, 0]


def mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (h ^ w.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def mixed(*words: np.ndarray) -> np.ndarray:
    """One hash of several words, in order."""
    return reduce(mix, words, np.zeros(len(words[0]), dtype=np.uint64))


def share(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges each hash is in."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def hashes(words: pa.Array) -> np.ndarray:
    """A hash for each of some words: the sum of those of its bytes, each with its place."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].astype(np.int64)
    ends -= ends[0]
    place = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends)) + 1
    return mixed(np.add.reduceat(mixed(place << 8 | data), ends[:-1]).view(np.int64)).view(np.int64)


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the distinct words and the end, the place among them of each text's words and its end, and
    the tokens of each text; none for a text without words."""
    words = [t.split() if t else [] for t in texts]
    lengths = np.array([len(w) + 1 if w else 0 for w in words], dtype=np.int64)
    flat = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
    known = np.append(hashes(flat.dictionary), END)
    ids = np.full(int(lengths.sum()), len(known) - 1, dtype=np.int32)
    inner = np.ones(len(ids), dtype=bool)
    inner[np.cumsum(lengths)[lengths > 0] - 1] = False
    ids[inner] = flat.indices.to_numpy()
    return known, ids, lengths


def step_of(base: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple:
    """Values of ``STEPS`` for texts as :func:`hashed` has them, each with what is chosen."""
    known, place = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    cuts = np.cumsum([len(x[0]) for x in parts])[:-1]
    ids = np.concatenate([at[x[1]] for x, at in zip(parts, np.split(place, cuts))])
    order = np.argsort(-np.bincount(ids, minlength=len(known)), kind="stable")
    rank = np.empty(len(known), dtype=np.uint16 if len(known) < 1 << 16 else np.uint32)
    rank[order] = np.arange(len(known))
    ids, lengths = rank[ids], np.concatenate([x[2] * 2 + x[3] for x in parts])
    return base, len(ids), ids.itemsize, known[order].tobytes(), packed(ids), len(lengths), packed(lengths)


def before(ids: np.ndarray, lengths: np.ndarray, start: int, k: int) -> np.ndarray:
    """The ``k``-th token before each one; ``start`` before a text."""
    out = np.full(len(ids), start, dtype=np.uint32)
    out[k:] = ids[: max(0, len(ids) - k)]
    first = np.cumsum(lengths) - lengths
    for j in range(k):
        out[(first + j)[lengths > j]] = start
    return out


def stepped(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, words, places of words, tokens of each row and whether it is chosen, of each stored step."""
    for t in batch.to_pylist():
        lengths = unpacked(t["lengths"], t["texts"], np.int64)
        yield t["base"], np.frombuffer(t["known"], dtype=np.int64), unpacked(t["ids"], t["n"], f"u{t['size']}"), lengths >> 1, lengths & 1


def frequent(steps: DataFrame, tokens: int) -> np.ndarray:
    """All words that are a quarter of a bucket's tokens, and some of an eighth. Where such a word is
    no eighth of a bucket's share of a step's tokens it isn't counted, which loses less than the half."""
    least = BUCKET / 8

    def run(batches):
        for _, known, ids, _, _ in (x for b in batches for x in stepped(b)):
            n = np.bincount(ids, minlength=len(known))
            many = n >= max(1, least / tokens * len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(known[many]), pa.array(n[many])], names=["w", "n"])

    found = steps.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # at most eight for each bucket; a text's start is before one token of each text and isn't counted
    return np.sort(np.array([START, *(r.w for r in found.select("w").collect())], dtype=np.int64))


def among(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether each word is one of the sorted ``hot``."""
    return hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words


def dealt(steps: DataFrame, order: int, hot: np.ndarray, buckets: int, part: range) -> DataFrame:
    """The tokens of the buckets ``part``: a row for each bucket and step, with the distinct words, the
    places of each token's words among them, and its row (from ``base``), doubled, plus one if chosen."""

    def run(batches):
        for base, known, ids, lengths, chosen in (x for b in batches for x in stepped(b)):
            if not len(ids):
                continue
            known = np.append(known, START)
            w = [ids, *[before(ids, lengths, len(known) - 1, k) for k in range(1, order)]]
            # by the list of words first, which is shorter than the tokens
            h = mixed(known)
            if order == 1:
                bucket = share(h, buckets).astype(np.int32)[ids]
            else:
                often = among(known, hot)
                bucket = share(h, buckets).astype(np.int32)[w[1]]
                many = np.flatnonzero(often[w[1]])
                bucket[many] = share(mix(h[w[1][many]], known[w[2 if order > 2 else 0][many]]), buckets)
            here = np.flatnonzero((bucket >= part.start) & (bucket < part.stop))
            mine = bucket[here] - part.start
            here = here[np.argsort(mine.astype(np.uint16) if len(part) < 1 << 16 else mine, kind="stable")]
            at = np.repeat((np.arange(len(lengths)) * 2 + chosen).astype(np.int32), lengths)[here]
            w, bucket, place, out = [x[here] for x in w], bucket[here], np.empty(len(known), dtype=np.uint32), []
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                every = np.concatenate([x[a:b] for x in w])
                own = np.sort(every)
                own = own[np.diff(own, prepend=own[:1] + 1) != 0]
                place[own] = np.arange(len(own))
                every = place[every].astype(np.uint16 if len(own) < 1 << 16 else np.uint32)
                gaps = np.diff(at[a:b], prepend=np.int32(0))
                gaps = gaps.astype(np.uint16) if 0 <= gaps.min() and gaps.max() < 1 << 16 else gaps
                out.append((int(bucket[a]), base, b - a, every.itemsize, gaps.itemsize, known[own].tobytes(), packed(every), packed(gaps)))
            if out:
                names = ["bucket", "base", "n", "size", "step", "known", "ids", "at"]
                kinds = [pa.int64()] * 5 + [pa.binary()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    schema = "bucket long, base long, n long, size long, step long, known binary, ids binary, at binary"
    return steps.mapInArrow(run, schema)


def opened(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row, chosen and words of each token of a bucket."""
    rows, chosen, words = [], [], []
    for t in table.to_pylist():
        n, known = t["n"], np.frombuffer(t["known"], dtype=np.int64)
        ids = unpacked(t["ids"], n * order, f"u{t['size']}").reshape(order, n)
        at = np.cumsum(unpacked(t["at"], n, "u2" if t["step"] == 2 else "i4").astype(np.int64))
        rows.append(t["base"] + at // 2)
        chosen.append(at % 2)
        words.append(known[ids])
    return np.concatenate(rows), np.concatenate(chosen), list(np.concatenate(words, axis=1))


def grouped(chosen: np.ndarray, w: list[np.ndarray], counts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Levels from the longest n-grams down to those of two words: counts for each model, the context
    and the place in the next level of each n-gram; then a token of each of the last ones, and for each token its longest n-gram's place."""
    levels, at, each = [], np.arange(len(chosen)), None
    weights = [chosen.astype(float) if c == "chosen" else np.ones(len(chosen)) for c in counts]
    for n in range(len(w), 1, -1):
        _, first, down = np.unique(mixed(*[x[at] for x in w[:n]]), return_index=True, return_inverse=True)
        own = [np.bincount(down, x, len(first)) for x in weights]
        if each is None:
            each = down
        else:
            levels[-1] += (down,)
        at = at[first]
        _, context = np.unique(mixed(*[x[at] for x in w[1:n]]), return_inverse=True)
        levels.append((own, context))
        weights = [(c > 0).astype(float) for c in own]
    return levels, at, each


def kinds(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in range(1, 5)]


def level_q(c: np.ndarray, context: np.ndarray, d: list[float], lower: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of the n-grams of a level; a context that the model never met says nothing."""
    cut = cut_of(c, d)
    total, kept = np.bincount(context, c)[context], np.bincount(context, cut)[context]
    return np.where(total > 0, (c - cut + kept * lower) / np.maximum(total, 1), lower)


def figures(c: np.ndarray) -> list[int]:
    """Counts of counts 1 to 4 and above 2, the sum and how many are met."""
    return [*kinds(c), int((c > 2).sum()), int(c.sum()), int((c > 0).sum())]


def asked(w: list[np.ndarray], hot: np.ndarray, at: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's n-grams of two words: which follow a frequent one, the distinct single words in order of their hashes,
    the place of each one's among them, the order by that place of those that follow frequent ones, and where in both the parts of the vocabulary begin."""
    often = among(w[1][at], hot) if len(w) > 1 else np.zeros(len(at), dtype=bool)
    words, place = np.unique(w[0][at].view(np.uint64), return_inverse=True)
    behind = np.argsort(place[often], kind="stable")
    begin = np.searchsorted(share(words, parts), np.arange(parts + 1))
    return often, words, place, behind, begin, np.searchsorted(place[often][behind], begin)


SEEN = "bucket long, part long, n_one long, n_two long, words binary, ones binary, a binary, b binary, twos binary"


def survey(order: int, counts: list[str], hot: np.ndarray, parts: int) -> Callable:
    """Of a bucket: counts of counts by level (part -1), and by part of the vocabulary its single words, with what
    they count here, and its n-grams of two words, the first frequent."""

    def run(key, table):
        _, chosen, w = opened(table, order)
        found = np.zeros((order + 1, len(counts), 4), dtype=np.int64)
        if order == 1:
            at, levels = np.arange(len(chosen)), []
            often, words, place, behind, begin, begin_two = asked(w, hot, at, parts)
            ones = [np.bincount(place, chosen if c == "chosen" else None, len(words)) for c in counts]
            a, b, twos = place[:0], place[:0], [place[:0] for _ in counts]
        else:
            levels, at, _ = grouped(chosen, w, counts)
            often, words, place, behind, begin, begin_two = asked(w, hot, at, parts)
            for n, (own, *_) in zip(range(order, 1, -1), levels):
                found[n] = [kinds(c if n > 2 else c[~often]) for c in own]
            ones = [np.bincount(place, (c > 0) & ~often, len(words)) for c in levels[-1][0]]
            a, b, twos = np.searchsorted(hot, w[1][at][often][behind]), place[often][behind], [c[often][behind] for c in levels[-1][0]]
        bucket = key[0].as_py()
        out = [(bucket, -1, 0, 0, None, found.tobytes(), None, None, None)]
        for p in range(parts):
            i, j = slice(*begin[p : p + 2]), slice(*begin_two[p : p + 2])
            if i.start < i.stop:
                one, two = (np.array([c[x] for c in y], dtype=np.int64) for y, x in ((ones, i), (twos, j)))
                gaps = np.diff(words[i], prepend=np.uint64(0))
                out.append((bucket, p, i.stop - i.start, j.stop - j.start, packed(gaps), packed(one), packed(a[j].astype(np.uint32)), packed((b[j] - i.start).astype(np.uint32)), packed(two)))
        kinds_of = [pa.int64()] * 4 + [pa.binary()] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds_of)], names=["bucket", "part", "n_one", "n_two", "words", "ones", "a", "b", "twos"])

    return run


COUNTED = "bucket long, part long, n_one long, n_two long, ones binary, twos binary, what long, model long, found array<long>"


def counted(models: int, hot: np.ndarray) -> Callable:
    """Of a part of the vocabulary, over all buckets: the counts that each bucket asked for, in its order, and
    the figures of single words (what -1) and of what follows each frequent one (its place)."""

    def run(key, table):
        rows = table.to_pylist()
        each = lambda c, n: np.concatenate([unpacked(r[c], models * r[n], np.int64).reshape(models, -1) for r in rows], axis=1)
        asks = [np.cumsum(unpacked(r["words"], r["n_one"], np.uint64), dtype=np.uint64) for r in rows]
        a = np.concatenate([unpacked(r["a"], r["n_two"], np.uint32) for r in rows]).astype(np.int64)
        b = np.concatenate([w[unpacked(r["b"], r["n_two"], np.uint32)] for r, w in zip(rows, asks)])
        words, place = np.unique(np.concatenate(asks), return_inverse=True)
        _, first, pair = np.unique(mixed(hot[a], b), return_index=True, return_inverse=True)
        ones, twos, told = [], [], []
        follows, spot = a[first], np.searchsorted(words, b[first])
        order = np.argsort(follows, kind="stable")
        cuts = np.flatnonzero(np.diff(follows[order], prepend=-1, append=-1)) if len(order) else []
        for m, (one, two) in enumerate(zip(each("ones", "n_one"), each("twos", "n_two"))):
            two = np.bincount(pair, two, len(first)).astype(np.int64)
            one = (np.bincount(place, one, len(words)) + np.bincount(spot, two > 0, len(words))).astype(np.int64)
            told.append((-1, m, figures(one)))
            told += [(int(follows[order[i]]), m, figures(two[order[i:j]])) for i, j in zip(cuts[:-1], cuts[1:])]
            ones.append(one[place])
            twos.append(two[pair])
        ones, twos, out, i, j = np.array(ones), np.array(twos), [], 0, 0
        for r in rows:
            n, k = r["n_one"], r["n_two"]
            out.append((r["bucket"], r["part"], n, k, packed(ones[:, i : i + n]), packed(twos[:, j : j + k]), None, None, None))
            i, j = i + n, j + k
        out += [(None, None, None, None, None, None, *t) for t in told]
        kinds_of = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64()] * 2 + [pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds_of)], names=["bucket", "part", "n_one", "n_two", "ones", "twos", "what", "model", "found"])

    return run


def told_of(known: pa.Table, begin: np.ndarray, begin_two: np.ndarray, models: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a bucket's single words and n-grams of two words, as :func:`counted` tells them by part."""
    ones, twos = np.zeros((models, begin[-1]), dtype=np.int64), np.zeros((models, begin_two[-1]), dtype=np.int64)
    for r in known.to_pylist():
        for out, n, data, start in ((ones, r["n_one"], r["ones"], begin[r["part"]]), (twos, r["n_two"], r["twos"], begin_two[r["part"]])):
            out[:, start : start + n] = unpacked(data, models * n, np.int64).reshape(models, n)
    return ones, twos


def cut_of(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


def losses_of(order: int, counts: list[str], hot: np.ndarray, parts: int, steps: dict[int, list[list[float]]], base: list[tuple], after: np.ndarray) -> Callable:
    """Of a bucket, with the counts that it asked for: the sums of each text's losses, packed by ``TOGETHER`` of rows.
    ``base`` has the sum and what is left to all words for each model, ``after`` sums and cuts after the frequent words."""

    def run(key, table, known):
        row, chosen, w = opened(table, order)
        levels, at, each = grouped(chosen, w, counts) if order > 1 else ([], np.arange(len(row)), np.arange(len(row)))
        often, _, place, behind, begin, begin_two = asked(w, hot, at, parts)
        ones, told = told_of(known, begin, begin_two, len(counts))
        twos = np.empty_like(told)
        twos[:, behind] = told
        follows = np.searchsorted(hot, w[1][at][often]) if order > 1 else None
        texts, text = np.unique(row, return_inverse=True)
        sums = []
        for m in range(len(counts)):
            total, left = base[m]
            q = ((ones[m] - cut_of(ones[m], steps[1][m])) / total + left)[place]
            if order > 1:
                one = q[often]
                q = level_q(levels[-1][0][m], levels[-1][1], steps[2][m], q)
                total, kept = after[m][:, follows]
                q[often] = np.where(total > 0, (twos[m] - cut_of(twos[m], steps[2][m]) + kept * one) / np.maximum(total, 1), one)
                for n, (own, context, down) in zip(range(3, order + 1), levels[-2::-1]):
                    q = level_q(own[m], context, steps[n][m], q[down])
            sums.append(np.bincount(text, -np.log(q)[each], len(texts)))
        group = texts >> TOGETHER
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        out = [(int(group[i]), (texts[i:j] - (group[i] << TOGETHER)).astype(np.int16).tobytes(), np.array([s[i:j] for s in sums]).tobytes()) for i, j in zip(cuts[:-1], cuts[1:])]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["rows", "at", "losses"])

    return run


def summed(models: int) -> Callable:
    """The losses of ``TOGETHER`` of rows over buckets."""

    def run(key, table):
        sums, met = np.zeros((models, 1 << TOGETHER)), np.zeros(1 << TOGETHER, dtype=bool)
        for at, losses in zip(table["at"], table["losses"]):
            at = np.frombuffer(at.as_py(), dtype=np.int16)
            sums[:, at] += np.frombuffer(losses.as_py()).reshape(models, len(at))
            met[at] = True
        at = np.flatnonzero(met)
        return pa.Table.from_arrays([pa.array((key[0].as_py() << TOGETHER) + at), *[pa.array(s[at]) for s in sums]], names=["row", *[f"loss{k}" for k in range(models)]])

    return run


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def score_texts(docs: DataFrame, counts: list[str], *, extra: tuple[str, ...], order: int, slices_: int = 4) -> DataFrame | None:
    """:func:`scored_texts`, without leaving shuffle files of one slice to the next."""
    with shuffles_dropped(docs.sparkSession):
        return scored_texts(docs, counts, extra=extra, order=order, slices_=slices_)


def scored_texts(docs: DataFrame, counts: list[str], *, extra: tuple[str, ...], order: int, slices_: int) -> DataFrame | None:
    """``docs`` is ``text``, ``chosen`` (is it learned from?) and ``extra`` columns;
    ``counts`` names one of ``chosen`` and ``total`` for each model; a model without
    any count takes the last one's place. Up to ``slices_`` slices of buckets are on disk one
    after the other. Per row: the extra columns, ``n_tokens`` and ``losses``; None if
    nothing is learned.

    The vocabulary is the words that the last column counts; one more stands for
    all others.
    """
    kept = docs.select(*extra, "chosen", F.monotonically_increasing_id().alias("row"), "text")
    kinds_of = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int64(), pa.binary()]
    names = [*extra, "chosen", "row", "n_tokens", *[x.split()[0] for x in STEPS.split(", ")]]

    def tokens(batches):
        """A row for each text, and one for each step."""
        parts, base, types = [], 0, []
        for batch in slices(batches, len(extra) + 2):
            if not parts:
                base = batch.column(len(extra) + 1)[0].as_py()
            parts.append((*hashed(batch.column(len(extra) + 2).to_pylist()), np.asarray(batch.column(len(extra)).to_pylist(), dtype=np.int64)))
            own = [*batch.columns[:-1], pa.array(parts[-1][2])]
            yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(batch.num_rows, k) for k in kinds_of]], names=names)
            types = [c.type for c in own]
            if sum(len(x[1]) for x in parts) >= STEP:
                yield step(types, base, parts)
                parts = []
        if parts:
            yield step(types, base, parts)

    def step(types, base, parts):
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types], *[pa.array([x], k) for x, k in zip(step_of(base, parts), kinds_of)]], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    store = written(kept.mapInArrow(tokens, f"{schema}, n_tokens long, {STEPS}"), "tokens")
    texts, store = store.where("base is null").select("row", "n_tokens", "chosen", *extra), store.where("base is not null").select(*names[-7:])
    size = texts.agg(F.sum("n_tokens").alias("total"), F.sum(F.when(F.col("chosen"), F.col("n_tokens"))).alias("chosen")).first()
    if not size[counts[-1]]:
        return None
    counts = [c if size[c] else counts[-1] for c in counts]
    models = len(counts)
    hot = frequent(store, size.total)
    slices_ = min(slices_, -(-size.total // (8 * BUCKET)))  # eight buckets in each at least, which tasks share
    each = max(1, -(-size.total // (slices_ * BUCKET)))
    ranges, parts = [range(k * each, (k + 1) * each) for k in range(slices_)], max(8, slices_ * each // 8)
    deal = lambda part: dealt(store, order, hot, slices_ * each, part).groupBy("bucket")
    seen = [written(deal(part).applyInArrow(survey(order, counts, hot, parts), SEEN), "seen") for part in ranges]
    every = union(seen)
    found = sum(np.frombuffer(r.ones, dtype=np.int64).reshape(order + 1, models, 4) for r in every.where("part < 0").select("ones").collect())
    # as many times as there are slices for four, so that no more than that of what was seen is on disk once more
    turns = max(1, slices_ // 4)
    met = union([written(every.where((F.col("part") >= 0) & (F.col("part") % turns == k)).groupBy("part").applyInArrow(counted(models, hot), COUNTED), "counted") for k in range(turns)])
    for part in seen:
        drop_written(part)
    tally = np.zeros((models, len(hot) + 1, 7), dtype=np.int64)  # the last of each: single words
    for r in met.where("what is not null").groupBy("what", "model").agg(*[F.sum(F.col("found")[k]).alias(f"f{k}") for k in range(7)]).collect():
        tally[r.model, r.what] = r[2:]
    found[1] += tally[:, -1, :4]
    if order > 1:
        found[2] += tally[:, :-1, :4].sum(axis=1)
    steps = {n: [discounts([int(x) for x in f]) for f in found[n]] for n in range(1, order + 1)}
    cuts = lambda f, d: f[..., 0] * d[0] + f[..., 1] * d[1] + f[..., 4] * d[2]
    single = tally[:, -1]
    base = [(int(single[m, 5]), cuts(single[m], steps[1][m]) / single[m, 5] / (single[-1, 6] + 1)) for m in range(models)]
    after = np.array([[tally[m, :-1, 5], cuts(tally[m, :-1], steps[min(2, order)][m])] for m in range(models)])
    told = met.where("bucket is not null").select("bucket", "part", "n_one", "n_two", "ones", "twos")
    sums = []
    for part in ranges:
        known = told.where(F.col("bucket").between(part.start, part.stop - 1)).groupBy("bucket")
        losses = deal(part).cogroup(known).applyInArrow(losses_of(order, counts, hot, parts, steps, base, after), "rows long, at binary, losses binary")
        sums.append(written(losses.groupBy("rows").applyInArrow(summed(models), ", ".join(["row long", *[f"loss{k} double" for k in range(models)]])), "losses"))
    scored = union(sums).groupBy("row").agg(F.array(*[F.sum(f"loss{k}") for k in range(models)]).alias("losses"))
    none = F.array(*[F.lit(0.0) for _ in counts])
    return texts.join(scored, "row", "left").select(*extra, "n_tokens", F.coalesce("losses", none).alias("losses"))
