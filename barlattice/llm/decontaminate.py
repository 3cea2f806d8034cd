"""Benchmark decontamination by a broadcast set of normalised n-grams.

Benchmark items become windows of ``n`` words (an item of fewer words is one
window). The hashes of all windows are broadcast; every document's windows are
hashed with a rolling polynomial and probed, and a probe that hits is verified
word by word. Spans of hit words, or whole documents, can then be removed.

The benchmark is sent in blocks: items are dealt by their key and text so that
one block stays near ``block_bytes`` of text, beyond a single item of more. A block is
held as arrays (16 bytes a window, 4 a word) and one entry for each distinct word,
some 25 times its text at most; a test measures it. Documents pass over the
blocks one after another, each pass adding to the hits of the one before, so a
benchmark of any size gives the same result and no broadcast exceeds the bound.

Null and empty texts have no words and no hits. Null benchmark texts have no
windows; items of a null key are one item, whose windows are hits like others'.
Repeated documents are each reported; items with equal windows are all counted.
Very long texts are scanned whole. Columns other than the key and the text are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(ASCII_LOWER)) if text else []


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of ``n`` ids."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = (out ^ ids[k : k + len(out)].astype(np.uint64)) * _MIX
            out ^= out >> np.uint64(29)
    return out


class Windows:
    """The windows of a block of items, by length: sorted hashes, and where in
    which item each begins."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.ids: dict[str, int] = {}
        self.names: list = []
        place: dict = {}
        texts, owners = [], []
        for item, text in items:
            words = words_of(text)
            if words:
                texts.append(np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], dtype=np.uint32))
                if item not in place:
                    place[item] = len(self.names)
                    self.names.append(item)
                owners.append(place[item])
        self.flat = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint32)
        found: dict[int, list] = {}
        at = 0
        for ids, owner in zip(texts, owners):
            size = min(n, len(ids))
            hashes = _hashes(ids, size)
            found.setdefault(size, []).append((hashes, np.arange(at, at + len(hashes), dtype=np.uint32), np.full(len(hashes), owner, dtype=np.uint32)))
            at += len(ids)
        self.by_size = {}
        for size, parts in found.items():
            hashes, starts, items_of = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((starts, items_of, hashes))
            hashes, starts, items_of = hashes[order], starts[order], items_of[order]
            again = np.zeros(len(hashes), dtype=bool)  # a window that its item holds twice
            again[1:] = (hashes[1:] == hashes[:-1]) & (items_of[1:] == items_of[:-1])
            for i in range(size):
                again[1:] &= self.flat[starts[1:] + i] == self.flat[starts[:-1] + i]
            self.by_size[size] = (hashes[~again], starts[~again], items_of[~again])

    def hits(self, words: list[str], at_once: int = 50_000) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items that occur."""
        hit, found = np.zeros(len(words), dtype=bool), set()
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], dtype=np.uint32)
        if not ids.any():
            return hit, found
        for size, (known, starts, items_of) in self.by_size.items():
            if len(words) < size:
                continue
            got = _hashes(ids, size)
            first, last = np.searchsorted(known, got), np.searchsorted(known, got, side="right")
            for some in np.array_split(np.flatnonzero(last > first), max(1, int((last - first).sum()) // at_once)):
                counts = last[some] - first[some]
                here = np.repeat(some, counts)
                there = np.repeat(first[some] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
                same = np.ones(len(here), dtype=bool)
                for i in range(size):
                    same &= ids[here + i] == self.flat[starts[there] + i]
                for i in range(size):
                    hit[here[same] + i] = True
                found.update(self.names[k] for k in np.unique(items_of[there[same]]).tolist())
        return hit, found


def blocks(benchmark: DataFrame, key: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark dealt by key and text into parts of about ``block_bytes``."""
    total = benchmark.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0
    n = int(total // block_bytes) + 1
    rows = benchmark.select(F.col(key).alias("item"), F.col(text).alias("text"))
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [rows]


def find_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """Per document: ``key, text, n_words, hit_spans, items``.

    ``hit_spans`` holds [first, last) word ranges; ``items`` the distinct item
    keys, as strings, in string order; items of a null key are one, a null at the end.
    """
    df = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    df = df.withColumns(
        {"n_words": F.lit(0).cast("long"), "hit_spans": F.expr("cast(array() as array<array<int>>)"), "items": F.expr("cast(array() as array<string>)")}
    )
    for part in blocks(benchmark, item_key, item_text, block_bytes):
        sent = df.sparkSession.sparkContext.broadcast(Windows([(None if r[0] is None else str(r[0]), r[1]) for r in part.collect()], n))

        def scan(batches, sent=sent):
            windows = sent.value
            for batch in slices(batches, 1):
                texts = batch.column(1).to_pylist()
                spans, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                counts = []
                for i, t in enumerate(texts):
                    words = words_of(t)
                    counts.append(len(words))
                    hit, found = windows.hits(words)
                    if found:
                        for a, b in spans[i]:
                            hit[a:b] = True
                        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                        spans[i] = edges.reshape(-1, 2).tolist()
                        items[i] = sorted(set(items[i]) | found, key=lambda k: (k is None, k))
                f = batch.schema
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, f.field(3).type), pa.array(items, f.field(4).type)], schema=f
                )

        df = df.mapInArrow(scan, df.schema)
    return df


def n_hit(spans="hit_spans"):
    """Hit words of a row of :func:`find_overlap`."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]))


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    max_share: float = 0.0,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """The rows of ``docs``, all columns, of whose words at most ``max_share``
    are hit."""
    place, last = docs.columns.index(text), len(docs.columns)
    parts = blocks(benchmark, item_key, item_text, block_bytes)
    # what blocks before have hit only counts where some words may be hit
    carry = max_share > 0 and len(parts) > 1
    if carry:
        docs = docs.withColumn("decontaminate_spans", F.expr("cast(array() as array<array<int>>)"))
    for part in parts:
        sent = docs.sparkSession.sparkContext.broadcast(Windows([(None if r[0] is None else str(r[0]), r[1]) for r in part.collect()], n))

        def run(batches, sent=sent):
            windows = sent.value
            for batch in slices(batches, place):
                kept = []
                spans = batch.column(last).to_pylist() if carry else None
                for i, t in enumerate(batch.column(place).to_pylist()):
                    words = words_of(t)
                    hit = windows.hits(words)[0]
                    if carry:
                        for a, b in spans[i]:
                            hit[a:b] = True
                        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                        spans[i] = edges.reshape(-1, 2).tolist()
                    kept.append(int(hit.sum()) <= max_share * len(words))
                if carry:
                    f = batch.schema
                    batch = pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(spans, f.field(last).type)], schema=f)
                yield batch.filter(pa.array(kept, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.select(*[docs[i] for i in range(last)]) if carry else docs


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, mark: str = " ", **options) -> DataFrame:
    """Every document with its hit spans cut out, ``mark`` in their place: ``key, text``.

    A span goes from the first to the last character of its words; what stands
    around it stays as it was.
    """
    found = find_overlap(docs, benchmark, **options)

    def cut(batches):
        for batch in slices(batches, 1):
            out = []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if spans:
                    at = [m.span() for m in WORD.finditer(t.translate(ASCII_LOWER))]
                    for a, b in reversed(spans):
                        t = t[: at[a][0]] + mark + t[at[b - 1][1] :]
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, batch.schema.field(1).type)], names=batch.schema.names[:2])

    return found.mapInArrow(cut, found.select(found.columns[0], "text").schema)
