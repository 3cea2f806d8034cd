"""Spelling variants against every pair of words, with parts of any size."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest

from barlattice.llm import spelling
from barlattice.llm.queries import misspelled


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(near), form, words[form] if form else None)

    def root(w):
        while out[w][2]:
            w = out[w][2]
        return w

    return {(w, *v, root(w)) for w, v in out.items()}


def grouped(spark, words, **kw):
    rows = spelling.variants(spark.createDataFrame(list(words.items()), spelling.COUNTS), **kw).collect()
    return [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in rows]


@pytest.mark.parametrize("part", [1, 60, 250_000])
def test_near_words_are_those_of_every_pair(spark, part):
    rng = random.Random(5)
    words = {"".join(rng.choices("abÉ", k=rng.randrange(1, 8))): rng.randrange(3, 40) for _ in range(260)}
    words |= {"aaaaaaaaaaaa": 90, "aaaaaaaaaaaaa": 40, "aaaaaaaaaaab": 20, "xaaaaaaaaaaab": 9, "aaaaaaxaaaaab": 9, "z": 3}
    got = grouped(spark, words, part=part)
    assert len(got) == len(words)
    assert set(got) == brute(words)


def test_no_words(spark):
    assert grouped(spark, {}) == []


def test_runs_are_counted_whole(spark):
    long = "Straße, straße! STRAße×x " * 60_000  # 1.5 million code points: several pieces
    texts = [(1, None), (2, ""), (3, long), (4, "one-two"), (None, "Naïve naïve naïve"), (4, "one-two")]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n long")
    want = Counter()
    for i, t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        run = ""
        for c in low + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{' ' if i is None else i}:{run}".encode())
                want[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    got = {r.word: r.n for r in spelling.vocabulary(docs, 1, 1, misspelled).collect()}
    assert got == want
    assert {r.word for r in spelling.vocabulary(docs, rewrite=misspelled).collect()} == {w for w, n in want.items() if len(w) >= 5 and n >= 3}


def test_pieces_cut_between_runs():
    text = "ab " * 10 + "c" * 50 + " d" * 10
    got = list(spelling.pieces(text, 7))
    assert "".join(got) == text
    assert Counter(r for p in got for r in spelling.RUN.findall(p)) == Counter(spelling.RUN.findall(text))


def test_a_hot_prefix_is_cut_deeper(spark):
    words = {f"prefix{a}{b}{c}": 3 + ord(a) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    dealt = spelling.cut(spark.createDataFrame(list(words.items()), spelling.COUNTS), part=900)
    sizes = dealt.groupBy("head").count().collect()
    assert max(r["count"] for r in sizes) * 9 <= 900 and dealt.count() == len(words)
    assert set(grouped(spark, words, part=900)) == brute(words)
