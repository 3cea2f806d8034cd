"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguises: compatibility forms, case, letters of other scripts
that look Latin, and digits or signs that stand for letters inside a word. The
lexicon holds whole words and word beginnings. Its weights are log odds learned
from labelled documents; a few common insults stand in it from the start. The
hits of a document that no exception phrase covers are summed up by weight, set
against the document's length, and turned into a score by a logistic function
fitted to the same labelled rows.

Learning takes at most ``max_toxic`` and ``max_clean`` labelled keys, in the
order of a hash of their key, and one text of each (the least). Near copies among
them, told by their least hash of three words over the whole sample, count as one.
Every feature whose excess among toxic rows chance does not explain comes to
the driver; the sample's bound is the only one. A feature is a whole word or a
beginning of 3 to 12 letters. Exception phrases are two-word phrases around a hit
that clean rows of the sample hold far more often than the word alone would have
it; a few stand from the start. Scoring takes every row and the whole text.

A null or empty text has no words and takes the score of a text without hits.
Repeated rows are scored each for itself; of repeated label rows the highest
label counts. With no usable labels the starting lexicon and a default
calibration serve. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, slices, small, written

#: Letters that look like Latin ones, by their code.
HOMOGLYPHS = str.maketrans(
    "авсԁеһіјкӏмнорԛѕтихуѡѵзьԝ" "αβγεηικμνορτυχω" "ıƖɑɡɩʟοꜱѐёїɢ",
    "abcdehijklmhopqstuxywv3bw" "abyenikuvoptuxw" "ilagilosee" "ig",
)
#: Digits and signs used for letters.
DIGITS = str.maketrans("0123456789@$!|", "oizeasgtbgasil")
DIGITS_L = str.maketrans("0123456789@$!|", "olzeasgtbgasll")
_SIGN = r"(?:[0-9]|[@$!|]+(?=[^\W_]))"
_MIXED = re.compile(rf"(?<![^\W_])(?:[^\W\d_]+{_SIGN}|{_SIGN}+[^\W\d_])(?:[^\W_]|{_SIGN})*")
_WORD = re.compile(r"[^\W\d_]+")

#: Insults that count before anything is learned, and phrases in which such words are harmless.
SEED = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "imbecile", "retard", "dumbass", "bastard", "asshole")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "class clown", "circus clown", "pond scum", "soap scum")


def _unmask(m: re.Match) -> str:
    w = m.group()
    if not any(c.isalpha() for c in w):
        return w
    a = w.translate(DIGITS)
    b = w.translate(DIGITS_L)
    return a if a == b else f"{a} {b}"


def fold(text: str | None) -> str:
    """Words of the folded text, one space between and around them."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    if not text.isascii():
        text = "".join(_WORD_OR_NOT(text))
    text = _MIXED.sub(_unmask, text)
    words = _WORD.findall(text)
    return f" {' '.join(words)} " if words else " "


def _WORD_OR_NOT(text: str):
    """Look-alike letters are exchanged only in words that also hold Latin
    letters, or that hold nothing but look-alikes."""
    at = 0
    for m in _FOREIGN.finditer(text):
        w = m.group()
        swapped = w.translate(HOMOGLYPHS)
        if swapped.isascii() or any("a" <= c <= "z" for c in w):
            yield text[at : m.start()]
            yield swapped
            at = m.end()
    yield text[at:]


_FOREIGN = re.compile(r"[^\W_]*[ıƖɐ-ʯͰ-ԯꜰ-ꟿ][^\W_]*")


@dataclass
class Lexicon:
    """Features and weights, exceptions, and the calibration of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -3.0
    slopes: tuple[float, float] = (2.0, 6.0)
    matcher: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "matcher": None}

    def automaton(self):
        if self.matcher is None:
            a = ahocorasick.Automaton()
            for f, w in self.weights.items():
                a.add_word(f, (len(f), w))
            for e in self.exceptions:
                a.add_word(f" {e} ", (len(e) + 2, None))
            a.make_automaton()
            self.matcher = a
        return self.matcher

    def total(self, folded: str) -> float:
        """Sum of the weights of hits; at one place of the text the strongest counts."""
        found: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton().iter(folded):
            start = end - size + 1
            if weight is None:
                safe.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if safe:
            found = {s: w for s, w in found.items() if not any(a <= s < b for a, b in safe)}
        return sum(found.values())

    def features(self, folded: str) -> tuple[float, float]:
        total = self.total(folded)
        return math.log1p(total), total / math.sqrt(8 + folded.count(" "))

    def score(self, text: str | None) -> float:
        x, y = self.features(fold(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slopes[0] * x + self.slopes[1] * y))))


def _seed() -> dict[str, float]:
    return {f" {w} ": 3.0 for w in SEED}


def _log_tail(k: int, n: int, p: float) -> float:
    """ln P(X >= k) for a binomial X, or a little over it."""
    if k <= n * p:
        return 0.0
    q = k / n
    d = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0)
    return -n * d


def features_of(folded: str, least: int = 3, most: int = 12) -> set[str]:
    """Whole words and word beginnings of a folded text."""
    out: set[str] = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(least, min(len(w) - 1, most) + 1))
    return out


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_toxic: int, max_clean: int) -> DataFrame:
    """The bounded sample to learn from, one row a key: ``text, toxic``."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("toxic"))
    picked = [rows.where(F.col("toxic") == v).orderBy(F.xxhash64("key"), "key").limit(n) for v, n in ((1, max_toxic), (0, max_clean))]
    sample = F.broadcast(picked[0].union(picked[1]))  # its size is bounded by the two limits
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(sample, "key")
    return found.groupBy("key").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_toxic: int = 6000,
    max_clean: int = 12000,
    chance: float = 2.5e-6,
) -> Lexicon:
    """Learn a lexicon and its calibration from the labelled rows given;
    ``chance`` is that of a feature's excess of toxic rows being none."""
    sample = written(labelled(docs, labels, key, text, label, max_toxic, max_clean), "sample")

    def fingerprint(batches):
        for batch in slices(batches, 0):
            folded = [fold(t) for t in batch.column(0).to_pylist()]
            kin = [kinship(t.split()) - (1 << 63) for t in folded]
            yield pa.RecordBatch.from_arrays([pa.array(folded, pa.string()), batch.column(1), pa.array(kin, pa.int64())], names=["folded", "toxic", "kin"])

    one_of_kin = sample.mapInArrow(fingerprint, "folded string, toxic int, kin long").groupBy("toxic", "kin").agg(F.min("folded").alias("folded"))
    one_of_kin = written(one_of_kin.select("folded", "toxic"), "kin")
    n_toxic, n_clean = one_of_kin.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n_toxic or not n_clean:
        return Lexicon(_seed())
    base = n_toxic / (n_toxic + n_clean)

    def count(batches):
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in slices(batches, 0):
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[bool(y)].update(set(t.split()))
        merged = [(w, seen[True][w], seen[False][w]) for w in {*seen[True], *seen[False]}]
        for at in range(0, len(merged), 50_000):
            columns = list(zip(*merged[at : at + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["word", "toxic", "clean"])

    words = one_of_kin.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ends = F.transform(F.sequence(F.lit(3), F.least(F.length("word") - 1, F.lit(12))), lambda k: F.concat(F.lit(" "), F.substring("word", 1, k)))
    parts = F.concat(F.array(F.concat(F.lit(" "), F.col("word"), F.lit(" "))), F.when(F.length("word") >= 4, ends).otherwise(F.array()))
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    divergence = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    strong = (
        words.select(F.explode(parts).alias("feature"), "toxic", "clean")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= 2) & (2 * F.col("toxic") > F.col("clean")))
        .where((share > base) & (-(F.col("toxic") + F.col("clean")) * divergence < math.log(chance)))
        .select("feature")
        .collect()
    )
    held = sorted({*(r[0] for r in strong), *_seed()})
    place = {f: i for i, f in enumerate(held)}
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def incidence(batches):
        known = sent.value
        for batch in slices(batches, 0):
            kept = [sorted(known[f] for f in features_of(fold(t)) if f in known) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(kept, pa.list_(pa.int32()))], names=["toxic", "features"])

    rows = sample.mapInArrow(incidence, "toxic int, features array<int>").where("toxic = 1 or size(features) > 0").collect()
    weights = choose(sorted((r.toxic, r.features) for r in rows), held, n_toxic, n_clean)
    lexicon = Lexicon({**{f: w for f, w in _seed().items() if f not in weights}, **weights})
    lexicon = Lexicon(lexicon.weights, tuple(sorted({*EXCEPTIONS, *exceptions(one_of_kin, lexicon)})))
    sent_lexicon = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches):
        own = sent_lexicon.value
        for batch in slices(batches, 0):
            both = [own.features(fold(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([b[0] for b in both]), pa.array([b[1] for b in both])], names=["toxic", "x", "y"])

    rows = sorted(sample.mapInArrow(measure, "toxic int, x double, y double").collect())
    drop_written(sample)
    drop_written(one_of_kin)
    return calibrate(lexicon, np.array([[r.x, r.y] for r in rows]), np.array([r.toxic for r in rows]))


def exceptions(rows: DataFrame, lexicon: Lexicon, *, least: int = 5, chance: float = 1e-6) -> list[str]:
    """Two-word phrases around the lexicon's hits that clean ``rows(folded, toxic)``
    hold, ``least`` at least, and toxic ones hardly: far more on the clean side
    than the same hit elsewhere."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def around(batches):
        matcher = sent.value.automaton()
        for batch in slices(batches, 0):
            out: set[tuple[int, int, str, str]] = set()
            for i, (t, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                for end, (size, weight) in matcher.iter(t):
                    if weight is None:
                        continue
                    start = end - size + 1
                    stop = t.index(" ", start + 1)
                    hit = t[start + 1 : start + size].strip()
                    out.add((i, y, hit, ""))
                    before = t.rfind(" ", 0, start) + 1
                    if start:
                        out.add((i, y, hit, t[before:stop]))
                    after = t.find(" ", stop + 1)
                    if after > 0:
                        out.add((i, y, hit, t[start + 1 : after]))
            columns = list(zip(*((y, h, p) for _, y, h, p in sorted(out)))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["toxic", "hit", "phrase"])

    counted = rows.mapInArrow(around, "toxic int, hit string, phrase string").groupBy("hit", "phrase").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    alone = counted.where("phrase = ''").select("hit", F.col("t").alias("all_t"), F.col("c").alias("all_c"))
    found = counted.where((F.col("phrase") != "") & (F.col("c") >= least) & (20 * F.col("t") <= F.col("c"))).join(small(alone), "hit")
    return sorted({r.phrase for r in found.collect() if _log_tail(r.c, r.c + r.t, (r.all_c - r.c + 1) / (r.all_c - r.c + r.all_t - r.t + 2)) < math.log(chance)})


def kinship(words: list[str]) -> int:
    """The least hash of three words in a row: near copies share it with a
    chance of their likeness, so that a group of them counts as a few."""
    if len(words) < 3:
        return xxhash.xxh3_64_intdigest(" ".join(words))
    return min(xxhash.xxh3_64_intdigest(f"{a} {b} {c}") for a, b, c in zip(words, words[1:], words[2:]))


def choose(rows: list[tuple[int, list[int]]], names: list[str], n_toxic: int, n_clean: int, least: int = 3, chance: float = 1e-4) -> dict[str, float]:
    """Greedy cover: the feature whose hits among the toxic rows not yet
    explained are least due to chance, given the clean rows that it hits too,
    until chance would do. Words that only come along with a toxic one explain
    nothing more. Features need not be pure: their weights differ, and how often
    they occur in what length of text decides. What a twentieth of the
    toxic rows share, and few clean rows have, is added at the end."""
    base = n_toxic / (n_toxic + n_clean)
    toxic_of: dict[int, set[int]] = {}
    clean_of: Counter = Counter()
    for i, (y, features) in enumerate(rows):
        for f in features:
            if y:
                toxic_of.setdefault(f, set()).add(i)
            else:
                clean_of[f] += 1

    def weight(f: int) -> float:
        return math.log((len(toxic_of[f]) + 0.5) / (n_toxic + 1)) - math.log((clean_of[f] + 0.5) / (n_clean + 1))

    place = {n: i for i, n in enumerate(names)}
    open_of = dict(toxic_of)
    left = {i for i, (y, _) in enumerate(rows) if y}
    chosen: dict[str, float] = {}
    while open_of:
        tails = {f: _log_tail(len(own & left), len(own & left) + clean_of[f], base) for f, own in open_of.items()}
        # among equals the longer beginning or the whole word, which says more
        best = min(tails, key=lambda f: (round(tails[f], 6), -len(names[f]), names[f]))
        if tails[best] > math.log(chance) or len(open_of[best] & left) < least:
            break
        chosen[names[best]] = max(0.5, min(8.0, weight(best)))
        left -= open_of.pop(best)
        open_of = {f: s for f, s in open_of.items() if s & left}
    for f, own in sorted(toxic_of.items(), key=lambda x: -len(names[x[0]])):
        name = names[f]
        if any(c.startswith(name) and len(toxic_of[place[c]]) == len(own) for c in chosen):
            continue
        pure = weight(f) >= 4 if name.endswith(" ") else len(name) >= 6 and clean_of[f] <= len(own) and weight(f) >= 2
        if pure and name not in chosen and len(own) >= max(5, 0.05 * n_toxic):
            chosen[name] = min(8.0, weight(f))
    return chosen


def calibrate(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> Lexicon:
    """Fit bias and slopes by penalised Newton steps."""
    if len(y) < 20 or y.min() == y.max():
        return lexicon
    a = np.column_stack([np.ones(len(y)), x])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(3) + 1e-9 * np.eye(3)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Lexicon(lexicon.weights, lexicon.exceptions, float(w[0]), (float(w[1]), float(w[2])))


def score(docs: DataFrame, lexicon: Lexicon, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key, score``, the score from 0 to 1."""
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        own = sent.value
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=[key, "score"])

    return rows.mapInArrow(run, rows.select(key, F.lit(0.0).alias("score")).schema)


def keep_clean(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``."""
    place = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        own = sent.value
        for batch in slices(batches, place):
            yield batch.filter(pa.array([own.score(t) < threshold for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
