"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A task tokenises its documents as a stream. Whole windows are cut from long
documents at once; what remains of each is cut into pieces of at most ``piece``
tokens and gathered. When ``gather`` tokens have come together, they are dealt
to the least number of windows that can hold them: partial partitions, largest
spread first, are merged with opposing imbalances, which leaves near-equal
windows. If one exceeds its capacity, the count of windows rises until none does.

Nothing is shuffled and a task holds ``gather`` tokens at most besides its batch.
Sequence ids come from the partition's number and a counter in it, so a task
that runs again gives the same rows.

A null text is an empty document: it is its end id alone. Repeated rows are
packed each for itself. Columns other than the key and the text are not read.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices


def encoder(path: str, ranks_path: str | None, pattern: str | None) -> Callable[[str], list[int]]:
    """Text to the ids of the tokenizer file ``path``.

    With ``ranks_path``, the same vocabulary as ranks, a faster library gives
    the same ids; a text that it refuses goes to the first one, and so does a text
    that holds an added token of the file, which the faster one would spell out.
    """
    slow: list = []

    def by_file(text: str) -> list[int]:
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(path))
        return slow[0].encode(text, add_special_tokens=False).ids

    if ranks_path is None:
        return by_file
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    added = [t["content"] for t in file.get("added_tokens") or [] if t["content"]]
    if file.get("normalizer") and added:  # a text may come to hold one
        return by_file
    holds_added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if holds_added(text):
            return by_file(text)
        try:
            return fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, GeneratorExit):
            raise
        except BaseException:  # noqa: BLE001  its native panics aren't Exceptions
            return by_file(text)

    return encode


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` dealt to ``k`` sets of near-equal sums."""
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = s
        heap.append((-s, i, sums, [[i]] + [[] for _ in range(k - 1)]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, sets_a = heapq.heappop(heap)
        _, _, b, sets_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        merged = [x + y for x, y in zip(sets_a, reversed(sets_b))]
        sums = sums[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), tick, sums, [merged[j] for j in order]))
        tick += 1
    return heap[0][3] if heap else [[] for _ in range(k)]


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their count rises until all hold."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = difference(sizes, k)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return [s for s in sets if s]
        k += 1


SCHEMA = "start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    ranks: str | None = None,
    pattern: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    capacity: int = 2048,
    piece: int = 384,
    gather: int = 160_000,
    finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    schema: str = SCHEMA,
) -> DataFrame:
    """Per piece: ``key, start, length, ids, doc_tokens, sequence_id, offset``.

    ``finish`` is applied to every batch of these rows where it is made, so that
    what needs only a digest of the ids never sends them; ``schema`` then names
    the columns after the key.
    """
    if not 0 < piece <= capacity:
        raise ValueError("0 < piece <= capacity is needed")
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        encode = encoder(tokenizer, ranks, pattern)
        base, made = TaskContext.get().partitionId() << 33, 0
        out: list[tuple] = []
        held: list[tuple] = []
        held_tokens = 0
        names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        types = [None, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]

        def flush():
            nonlocal held, held_tokens, made
            for window in deal([len(p[2]) for p in held], capacity) if held else []:
                offset = 0
                for i in sorted(window):
                    doc, start, ids, total = held[i]
                    out.append((doc, start, len(ids), ids, total, base + made, offset))
                    offset += len(ids)
                made += 1
            held, held_tokens = [], 0

        def batch_of(key_type):
            columns = list(zip(*out))
            done = pa.RecordBatch.from_arrays([pa.array(c, t or key_type) for c, t in zip(columns, types)], names=[key, *names[1:]])
            out.clear()
            return finish(done) if finish else done

        key_type = None
        for batch in slices(batches, 1):
            key_type = batch.schema.field(0).type
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(encode(t) + [end_id], dtype=np.int32)
                whole = len(ids) // capacity * capacity
                for at in range(0, whole, capacity):
                    out.append((doc, at, capacity, ids[at : at + capacity], len(ids), base + made, 0))
                    made += 1
                for at in range(whole, len(ids), piece):
                    held.append((doc, at, ids[at : at + piece], len(ids)))
                    held_tokens += len(held[-1][2])
                if held_tokens >= gather:
                    flush()
            if out:
                yield batch_of(key_type)
        flush()
        if out:
            yield batch_of(key_type)

    return rows.mapInArrow(run, f"`{key}` {kind}, {schema}")
