"""Repair of conversations whose turns are blank, repeated, cut short or out of order.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``. The
edits that make it so are a cheapest path through a lattice of (turns consumed,
state of that grammar), found by Dijkstra's algorithm under the key (cost, audit):
Keep costs 0, Rerole to user or assistant 3, Delete 4 (all that may happen to a
blank or repeated turn), Insert of an empty turn of user or assistant 3, and a turn
cut short that stays adds 3. The audit is the edits' initials in order; of cheapest
paths the one whose audit comes first in ASCII is taken, and the search ends at the
first accepting end node that it pops. Which role an Rerole or Insert takes follows
from the state.

Turns are ordered by turn (nulls first), then role, then text. The first fault of a
turn counts: blank (nothing but white space), duplicate (role and text stood
earlier), truncated (the last sign that is no white space is none of ``.!?``).

Conversations of up to ``block`` turns and ``block_bytes`` are read whole by the task
that has them in order. One that is longer is cut into blocks wherever its rows lie
(ordered by range, so that it spreads over tasks). Each block is solved for every
state it may be entered in and left in; a path's audits up to a border end with a
consumed turn, so none is a prefix of another, and (cost, rank of audit) is all that
has to be carried from block to block. The digest of a repaired conversation is one
hash over its text in order and so one stream, of which no more than a batch is held.

A null role or text counts as one space, which makes the text blank. Rows without
conversation id form one conversation. An empty table has no conversations; extra
columns are not read. Rows whose ``present`` is false only name their conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, join_hot, slices, small, written

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

#: States: nothing yet, after system, after user, after assistant; where a role's initial leads from each.
LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
#: The state that a turn of a free role leads to, that role, and the inserts that end a conversation.
FREE, ROLE, TAIL = (2, 2, 3, 2), ("user", "user", "assistant", "user"), ("", "II", "I", "")
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3

REPAIRED = "conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def own_fault(text: str) -> int:
    said = text.rstrip(WHITE)
    return BLANK if not said else SOUND if said[-1] in ".!?" else TRUNCATED


def paths(initials: list[str], faults: list[int], start: int, whole: bool) -> dict[int, tuple[int, str]]:
    """State to (cost, audit) of its cheapest path over all turns from ``start``.
    With ``whole`` inserts may follow the last turn and the search ends at the
    first accepting state; without, every state that can be reached is settled."""
    n, settled, ends = len(initials), set(), {}
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in settled:
            continue
        settled.add((at, state))
        if at == n:
            if not whole:
                ends[state] = (cost, audit)
                continue
            if state in ACCEPTING:
                return {state: (cost, audit)}
        else:
            fault = faults[at]
            heapq.heappush(heap, (cost + DELETE, audit + "D", at + 1, state))
            if fault in (SOUND, TRUNCATED):
                stays = cost + (CUT_SHORT if fault == TRUNCATED else 0)
                if (nxt := LEADS[state].get(initials[at])) is not None:
                    heapq.heappush(heap, (stays, audit + "K", at + 1, nxt))
                heapq.heappush(heap, (stays + REROLE, audit + "R", at + 1, FREE[state]))
        heapq.heappush(heap, (cost + INSERT, audit + "I", at, FREE[state]))
    return ends


class Digest:
    """SHA-256 over the turns of a repaired conversation as they come."""

    def __init__(self) -> None:
        self.state, self.hash, self.begun = 0, hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.begun else "") + role + ":" + text).encode())
        self.begun = True

    def edit(self, letter: str, role: str = "", text: str = "") -> None:
        if letter == "K":
            self._say(role, text)
            self.state = LEADS[self.state][role[:1]]
        elif letter in "RI":
            self._say(ROLE[self.state], text if letter == "R" else "")
            self.state = FREE[self.state]

    def play(self, audit: str, turns: list[tuple[str, str]]) -> None:
        left = iter(turns)
        for letter in audit:
            self.edit(letter, *(("", "") if letter == "I" else next(left)))


def count_illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _solved(key, turns: list[tuple]) -> tuple:
    """The result row of a conversation whose ``(turn, role, text)`` are in order."""
    numbers = [t for t, _, _ in turns if t is not None]
    said, faults, seen = [(r, x) for _, r, x in turns], [], set()
    for pair in said:
        fault = own_fault(pair[1])
        faults.append(DUPLICATE if fault != BLANK and pair in seen else fault)
        seen.add(pair)
    initials = [r[:1] for r, _ in said]
    ((cost, audit),) = paths(initials, faults, 0, True).values()
    digest = Digest()
    digest.play(audit, said)
    gaps = numbers[-1] - numbers[0] + 1 - len(set(numbers)) if numbers else 0
    return (key, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), count_illegal(initials), cost, audit, digest.hash.hexdigest())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _results(key: pa.DataType) -> pa.Schema:
    whole = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return pa.schema([("conv_id", key), *((c, pa.int64()) for c in whole), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _repair_short(turns: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, key, held, out = False, None, [], []
        for batch in slices(batches, 4):
            schema = _results(batch.schema.field(0).type)
            for conv, turn, present, role, text in _rows(batch):
                if begun and conv != key:
                    out.append(_solved(key, held))
                    held = []
                begun, key = True, conv
                if present:
                    held.append((turn, role, text))
            if len(out) > 500:
                yield _batch(out, schema)
                out = []
        if begun:
            out.append(_solved(key, held))
            yield _batch(out, schema)

    dealt = turns.select("conv_id", "turn", "present", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, REPAIRED.format(key=kind))


def _numbered(turns: DataFrame, kind: str, number: str, block: int, block_bytes: int) -> DataFrame:
    """The turns with ``block`` and ``place`` in it; blocks ascend with the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place, held, begun, key = TaskContext.get().partitionId() << 40, 0, 0, False, None
        for batch in slices(batches, 3):
            blocks, places, faults, marks = [], [], [], []
            for conv, _, role, text in _rows(batch):
                if begun and (conv != key or place == block or held > block_bytes):
                    at, place, held = at + 1, 0, 0
                begun, key = True, conv
                blocks.append(at)
                places.append(place)
                faults.append(own_fault(text))
                marks.append(hashlib.md5(f"{conv}:{len(role)}:{role}{text}".encode()).digest())
                place, held = place + 1, held + len(text)
            more = [pa.array(blocks, pa.int64()), pa.array(places, pa.int32()), pa.array(faults, pa.int32()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "block", "place", "fault", "mark"])

    order = ["conv_id", "turn", "role", "text"]
    ranged = turns.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, f"conv_id {kind}, turn {number}, role string, text string, block long, place int, fault int, mark binary")


#: A block's path for each (entry, exit), and what its neighbours need to know of it.
BLOCKS = (
    "block long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, turns long, first_turn long, last_turn long, "
    "entry array<int>, exit array<int>, cost array<long>, rank array<int>, audit array<string>"
)


def _blocks(light: DataFrame, kind: str) -> DataFrame:
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    types = [pa.list_(kinds[t[6:-1]]) if t.startswith("array") else kinds[t] for t in (f.split()[1] for f in BLOCKS.split(", "))]

    def solved(key, block: int, turns: list[tuple]) -> tuple:
        numbers, initials, faults = [t for t, _, _ in turns if t is not None], [i for _, i, _ in turns], [f for _, _, f in turns]
        found = []
        for entry in range(4):
            ends = paths(initials, faults, entry, False)
            ranks = {state: r for r, state in enumerate(sorted(ends, key=lambda s: ends[s][1]))}
            found += [(entry, state, cost, ranks[state], audit) for state, (cost, audit) in ends.items()]
        first, last = (numbers[0], numbers[-1]) if numbers else (None, None)
        counts = [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
        return (key, block, *counts, count_illegal(initials), initials[0], initials[-1], len(set(numbers)), first, last, *map(list, zip(*found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = key = at = None
        held = []
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), *zip(names, types)])
            for conv, block, turn, initial, fault in _rows(batch):
                if held and block != at:
                    yield _batch([solved(key, at, held)], schema)
                    held = []
                key, at = conv, block
                held.append((turn, initial, fault))
        if held:
            yield _batch([solved(key, at, held)], schema)

    dealt = light.repartition("block").sortWithinPartitions("block", "place").select("conv_id", "block", "turn", "initial", "fault")
    return dealt.mapInArrow(run, f"conv_id {kind}, {BLOCKS}")


def _chosen(blocks: DataFrame, kind: str) -> DataFrame:
    """For each block the states it is entered and left in, and at a conversation's
    last one the counts; ``tail`` are inserts after the last turn."""
    fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def folded(key, rows: Iterator[tuple]) -> tuple[list[tuple], array, bytearray]:
        costs, order, ids, back = {0: 0}, {0: 0}, array("q"), bytearray()
        counts, distinct, first, last, before = [0, 0, 0], 0, None, None, None
        illegal = 0
        for block, blank, duplicate, truncated, inner, initial, final, turns, low, high, entry, exit_, cost, rank in rows:
            best: dict[int, tuple] = {}
            for s, t, c, r in zip(entry, exit_, cost, rank):
                if s in costs:
                    best[t] = min(best.get(t, (1 << 62,)), (costs[s] + c, order[s], r, s))
            order = {t: r for r, t in enumerate(sorted(best, key=lambda t: best[t][1:3]))}
            costs = {t: found[0] for t, found in best.items()}
            ids.append(block)
            back += bytes(best[t][3] if t in best else 9 for t in range(4))
            counts = [a + b for a, b in zip(counts, (blank, duplicate, truncated))]
            illegal += inner + (before is not None and before + initial not in ("su", "ua", "au"))
            distinct += turns - (low is not None and low == last)
            first, last, before = low if first is None else first, high if high is not None else last, final
        cost, _, end = min((c + INSERT * len(TAIL[s]), order[s], s) for s, c in costs.items())
        gaps = last - first + 1 - distinct if first is not None else 0
        return (gaps, *counts, illegal, cost), end, ids, back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (r for b in batches for r in _rows(b))
        for key, own in groupby(rows, key=lambda r: r[0]):
            totals, end, ids, back = folded(key, (r[1:] for r in own))
            kind_of = pa.int64() if isinstance(key, int) or key is None else pa.string()
            schema = pa.schema([("conv_id", kind_of), ("block", pa.int64()), ("came", pa.int32()), ("went", pa.int32()), ("tail", pa.string()), *((f, pa.int64()) for f in fields)])
            out, tail, more = [], TAIL[end], totals
            for at in range(len(ids) - 1, -1, -1):
                came = back[4 * at + end]
                out.append((key, ids[at], came, end, tail, *more))
                end, tail, more = came, "", (None,) * len(fields)
                if len(out) > 5000:
                    yield _batch(out, schema)
                    out = []
            yield _batch(out, schema)

    dealt = blocks.select("conv_id", "block", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "turns", "first_turn", "last_turn", "entry", "exit", "cost", "rank")
    schema = f"conv_id {kind}, block long, came int, went int, tail string, " + ", ".join(f"{f} long" for f in fields)
    return dealt.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, schema)


def _digests(ordered: DataFrame, pieces: DataFrame, kind: str) -> DataFrame:
    """``conv_id, audit, repaired_sha256``: the pieces of a conversation's audit are
    rows ahead of those of their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        begun, key, digest, audit, left = False, None, Digest(), [], iter("")

        def ended():
            for letter in left:
                digest.edit(letter)

        for batch in slices(batches, 4):
            schema = schema.set(0, batch.schema.field(0))
            for conv, _, place, role, text in _rows(batch):
                if begun and conv != key:
                    ended()
                    yield _batch([(key, "".join(audit), digest.hash.hexdigest())], schema)
                    digest, audit, left = Digest(), [], iter("")
                begun, key = True, conv
                if place < 0:
                    ended()
                    audit.append(text)
                    left = iter(text)
                    continue
                for letter in left:
                    digest.edit(letter, role, text)
                    if letter != "I":
                        break
        if begun:
            ended()
            yield _batch([(key, "".join(audit), digest.hash.hexdigest())], schema)

    heads = pieces.select("conv_id", "block", F.lit(-1).alias("place"), F.lit("").alias("role"), F.col("piece").alias("text"))
    both = ordered.select("conv_id", "block", "place", "role", "text").unionByName(heads)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place").mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string")


def _repair_long(turns: DataFrame, kind: str, number: str, block: int, block_bytes: int) -> DataFrame:
    ordered = written(_numbered(turns, kind, number, block, block_bytes), "turns")
    place = F.struct("block", "place")
    repeated = ordered.groupBy("mark").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    light = join_hot(ordered.select("conv_id", "block", "place", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "mark"), repeated, "mark", how="left")
    again = (F.col("fault") != BLANK) & F.col("first").isNotNull() & (place > F.col("first"))
    blocks = written(_blocks(light.withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("fault"))), kind), "blocks")
    chosen = written(_chosen(blocks, kind), "chosen")
    each = blocks.select("block", F.explode(F.arrays_zip("entry", "exit", "audit")).alias("path")).select("block", "path.*")
    pieces = chosen.join(each, (chosen.block == each.block) & (chosen.came == each.entry) & (chosen.went == each.exit)).select(
        "conv_id", chosen.block, F.concat("audit", "tail").alias("piece")
    )
    totals = chosen.where("cost is not null").drop("block", "came", "went", "tail")
    digests = _digests(ordered, pieces, kind).withColumnRenamed("conv_id", "of")
    out = totals.join(digests, totals.conv_id.eqNullSafe(F.col("of"))).drop("of")
    result = written(out, "repaired")
    for df in (ordered, blocks, chosen):
        drop_written(df)
    return result


def repair(turns: DataFrame, block: int = 1024, block_bytes: int = 8 << 20) -> DataFrame:
    """A row of faults and edits for each conversation of ``turns(conv_id, turn, role,
    text)`` and, if the frame has it, ``present``: gaps in the turns' numbers, counts
    of first faults, neighbours of illegal roles before the repair, cost and audit of
    the edits, and the SHA-256 of the repaired ``role:text`` lines."""
    kind, number = turns.schema["conv_id"].dataType.simpleString(), turns.schema["turn"].dataType.simpleString()
    present = F.coalesce("present", F.lit(True)) if "present" in turns.columns else F.lit(True)
    space = F.lit(" ")
    own = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), present.alias("present"))
    sizes = own.where("present").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.octet_length("text")).alias("bytes"))
    long_ = written(sizes.where((F.col("turns") > block) | (F.col("bytes") > block_bytes)).select(F.col("conv_id").alias("long_id")), "long")
    if long_.isEmpty():
        return _repair_short(own, kind)
    same = own.conv_id.eqNullSafe(F.col("long_id"))
    short = _repair_short(own.join(small(long_), same, "left_anti"), kind)
    return short.unionByName(_repair_long(own.where("present").join(small(long_), same, "left_semi"), kind, number, block, block_bytes))
