"""Repaired conversations against a table of cheapest rests, whole and in blocks."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from barlattice.llm import conversation_repair as R
from barlattice.llm.queries import damaged

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one
    conversation's (turn, role, text), by recursion over what is left."""
    turns = sorted(((t, r or " " if r != "" else "", x if x is not None else " ") for t, r, x in turns), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    faults, seen = [], []
    for _, role, text in turns:
        said = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("b" if not said else "d" if (role, text) in seen else "" if said[-1] in ".!?" else "t")
        seen.append((role, text))
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def rest(at, before, inserts=0):
        """Cheapest (cost, audit, lines) from turn ``at`` on after a kept role ``before``."""
        options = []
        if at == len(turns):
            if before in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text = turns[at]
            options.append(joined(4, "D", (), rest(at + 1, before)))
            if faults[at] in ("", "t"):
                extra = 3 if faults[at] == "t" else 0
                if role[:1] and role[:1] in allowed[before]:
                    options.append(joined(extra, "K", (f"{role}:{text}",), rest(at + 1, role[:1])))
                for new in ("user", "assistant"):
                    if new[0] in allowed[before]:
                        options.append(joined(3 + extra, "R", (f"{new}:{text}",), rest(at + 1, new[0])))
        if inserts < 3:
            for new in ("user", "assistant"):
                if new[0] in allowed[before]:
                    options.append(joined(3, "I", (f"{new}:",), rest(at, new[0], inserts + 1)))
        return min((o for o in options if o), key=lambda o: o[:2], default=None)

    def joined(cost, letter, lines, tail):
        return tail and (cost + tail[0], letter + tail[1], lines + tail[2])

    cost, audit, lines = rest(0, "")
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
    counts = [faults.count(f) for f in "bdt"]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "  ", "", None, "So?\n", "é!", "a. "]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 14)):
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                rows.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choices(roles, [6, 6, 1, 1, 1, 1])[0], rng.choices(texts, [5, 3, 1, 1, 1, 2, 2, 1])[0]))
    return rows


def repaired(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "m", 1) for r in rows], SCHEMA + ", mark string, block int")
    return {r.conv_id: tuple(r)[1:] for r in R.repair(df, **kw).collect()}


@pytest.mark.parametrize("kw", [{}, {"block": 3}, {"block": 5, "block_bytes": 6}, {"block": 1}], ids=str)
def test_repairs_are_the_cheapest(spark, kw):
    rows = conversations()
    want = {}
    for row in rows:
        want.setdefault(row[0], []).append(row[1:])
    assert repaired(spark, rows, **kw) == {conv: brute(turns) for conv, turns in want.items()}


def test_one_conversation_over_many_blocks_equals_the_whole(spark):
    rng = random.Random(8)
    rows = [(7, i // 2 * 2, rng.choice(["user", "assistant"]), rng.choice(["one.", "two", "three!", f"text {i}."])) for i in range(3000)]
    got = R.repair(spark.createDataFrame(rows, SCHEMA), block=64).collect()
    assert got == R.repair(spark.createDataFrame(rows, SCHEMA), block=4000).collect()
    cost, audit = got[0].cost, got[0].audit
    assert cost == 3 * (audit.count("R") + audit.count("I")) + 4 * audit.count("D") + 3 * sum(1 for a in turns_kept(rows, audit) if not a)


def turns_kept(rows, audit):
    """Whether the text of each turn that stays is whole."""
    left = iter(sorted(rows, key=lambda r: r[1:]))
    for letter in audit:
        if letter != "I":
            text = next(left)[3]
            if letter != "D":
                yield text[-1] in ".!?"


def test_no_turns_and_only_dropped_ones(spark):
    assert repaired(spark, []) == {}
    rows = [(c, t, "user", "Hi.") for c in range(400) for t in (None, 0)]
    whole = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in R.repair(damaged(whole)).collect()}
    assert got.keys() == set(range(400))
    dropped = [c for c in got if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (" ", 0))]
    assert dropped
    for c in dropped:
        assert tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y" * 3_000_000), (1, 2, "user", "x" * 3_000_000 + "."), (1, 3, "assistant", "z.")]
    got = repaired(spark, rows, block_bytes=4 << 20)
    assert got == {1: brute([r[1:] for r in rows])}
