"""Spelling variants: words one edit apart, each tied to a far more frequent one.

The vocabulary is a trie that is dealt by prefix. Below a prefix one task walks
its part of the trie and carries each node's active set, the nodes at most one
edit away: a child's set follows from its parent's by one letter, and at a node
that ends a word the ends of words in its set are the near words. A prefix under
which too much lies is cut deeper (2, 4, 8 ... letters), so that no part exceeds
a stated size whatever the vocabulary. Above the cuts a pair of nodes that have
parted can only walk down equal letters, so what is left of both words is equal:
there the pairs come from equality joins on (place of the edit, word without that
letter), whose groups hold at most one word for each letter of the alphabet.

A word gets the number of its near words and the most frequent of them, never
the pairs, so that work stays linear in the words of a group.

Null texts have no words, nor has an empty table. Very long texts are counted
piece by piece, cut between words. Repeated rows count each for itself. Extra
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, join_hot, slices, small, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")

#: Code points of text looked at together, and distinct words that a task holds before it hands counts on.
PIECE, HELD = 1 << 20, 200_000

#: Code points of the words below one prefix that a task takes.
PART = 250_000

COUNTS = "word string, n long"
NEAR = "word string, n long, n_near long, best struct<minus_n:long,word:string>"


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``most`` code points, cut where no run is."""
    at = 0
    while len(text) - at > most:
        gap = NO_LETTER.search(text, at + most)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def lowered(run: str) -> str:
    """A-Z to a-z and nothing else; a run has no letter beyond U+00FF."""
    return run.encode("latin-1").lower().decode("latin-1")


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, rewrite: Callable[[object], Callable[[str], str]] | None = None) -> DataFrame:
    """``word, n`` of the lower-cased runs of letters of ``docs(doc_id, text)``
    with so many code points and occurrences. ``rewrite(doc_id)`` gives a function
    that changes the runs of a document before they are counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def handed():
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in slices(batches, 1):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own: Counter[str] = Counter()
                for piece in pieces(text.as_py()):
                    own.update(RUN.findall(piece))
                low: Counter[str] = Counter()
                for run, n in own.items():
                    low[lowered(run)] += n
                change = rewrite(key) if rewrite else None
                for run, n in low.items():
                    word = change(run) if change else run
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield handed()
        if held:
            yield handed()

    runs = docs.select("doc_id", "text").where("text is not null").mapInArrow(count, COUNTS)
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def cut(words: DataFrame, part: int = PART) -> DataFrame:
    """``words(word, n)`` with ``cut``, the letters of the prefix that a word is
    dealt by, and that prefix, ``head``: the least of 2, 4, 8 ... under which at
    most ``part`` code points of words lie, or a single word."""
    done, open_, letters = None, words, 2
    while True:
        headed = open_.withColumn("cut", F.lit(letters)).withColumn("head", F.substring("word", 1, letters))
        sizes = headed.groupBy("head").agg(F.count("*").alias("held"), F.sum(F.length("word")).alias("points"))
        heavy = written(sizes.where((F.col("held") > 1) & (F.col("points") > part)).select("head", F.lit(True).alias("heavy")), "heavy")
        if heavy.isEmpty():
            return headed if done is None else done.unionByName(headed)
        marked = headed.join(small(heavy), "head", "left")
        light = marked.where("heavy is null").drop("heavy")
        done = light if done is None else done.unionByName(light)
        open_, letters = marked.where("heavy").select("word", "n"), letters * 2


def near_in_part(words: list[str], counts: list[int]) -> tuple[list[int], list[int]]:
    """For each word the number of the others one edit away, and the place of the
    most frequent (of those the least in code-point order), or -1.

    The trie's nodes are numbers; ``down[v]`` holds a node's children by letter.
    A node's active set is itself, at distance 0, and the nodes at distance 1.
    """
    down: list[dict[str, int]] = [{}]
    ends = [-1]
    for place, word in enumerate(words):
        at = 0
        for letter in word:
            nxt = down[at].get(letter)
            if nxt is None:
                nxt = down[at][letter] = len(down)
                down.append({})
                ends.append(-1)
            at = nxt
        ends[at] = place
    n_near, best = [0] * len(words), [-1] * len(words)

    def settle(node: int, active: set[int]) -> None:
        if (own := ends[node]) >= 0:
            found = [ends[v] for v in active if ends[v] >= 0]
            if found:
                n_near[own] = len(found)
                best[own] = min(found, key=lambda p: (-counts[p], words[p]))

    settle(0, active := set(down[0].values()))
    stack = [(0, active)]
    while stack:
        node, active = stack.pop()
        children = down[node]
        siblings = children.values()
        for letter, child in children.items():
            # From the parent itself: the letter left out, another in its place, one more after it.
            mine = {node, *siblings, *down[child].values()}
            # From the nodes one edit away: the same letter.
            for v in active:
                if (nxt := down[v].get(letter)) is not None:
                    mine.add(nxt)
            mine.discard(child)
            settle(child, mine)
            if down[child]:
                stack.append((child, mine))
    return n_near, best


def _in_parts(dealt: DataFrame) -> DataFrame:
    """Near words whose edit lies below the cut, a row of NEAR for every word."""
    best_kind = pa.struct([("minus_n", pa.int64()), ("word", pa.string())])

    def solved(letters: int, words: list[str], counts: list[int]) -> pa.RecordBatch:
        n_near, best = near_in_part([w[letters:] for w in words], counts)
        found = [None if b < 0 else {"minus_n": -counts[b], "word": words[b]} for b in best]
        columns = [pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(n_near, pa.int64()), pa.array(found, best_kind)]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n", "n_near", "best"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, counts = None, [], []
        for batch in batches:
            for head, letters, word, n in zip(*(batch.column(c).to_pylist() for c in ("head", "cut", "word", "n"))):
                if part != (letters, head):
                    if words:
                        yield solved(part[0], words, counts)
                    part, words, counts = (letters, head), [], []
                words.append(word)
                counts.append(n)
        if words:
            yield solved(part[0], words, counts)

    return dealt.repartition("head").sortWithinPartitions("cut", "head", "word").mapInArrow(walk, NEAR)


def _above_cuts(dealt: DataFrame) -> DataFrame:
    """Near words whose edit lies above the cut, as rows of NEAR (n null)."""
    places = F.sequence(F.lit(0), F.least("cut", F.length("word")) - 1)
    without = F.concat(F.expr("left(word, place)"), F.expr("substring(word, place + 2)"))
    keys = dealt.withColumn("place", F.explode(places)).select("word", "n", "place", without.alias("rest"), F.expr("substring(word, place + 1, 1) <> substring(word, place + 2, 1)").alias("last_of_run"))
    of = F.struct((-F.col("n")).alias("minus_n"), "word")
    groups = keys.groupBy("place", "rest").agg(F.sort_array(F.collect_list(of)).alias("members")).where(F.size("members") > 1)
    nothing = F.lit(None).cast("long").alias("n")
    replaced = groups.select(F.explode("members").alias("own"), F.col("members")[0].alias("first"), F.col("members")[1].alias("second"), (F.size("members") - 1).cast("long").alias("n_near")).select(
        F.col("own.word").alias("word"), nothing, "n_near", F.when(F.col("own.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best")
    )
    # A letter more or less; in a run of equal letters the last one is taken, so that a pair counts once.
    more = keys.where("last_of_run").select(F.col("word").alias("long_word"), F.col("n").alias("long_n"), F.col("rest").alias("word"))
    pairs = more.join(dealt.select("word", "n"), "word")
    one = F.lit(1).cast("long").alias("n_near")
    shorter = pairs.select("word", nothing, one, F.struct((-F.col("long_n")).alias("minus_n"), F.col("long_word").alias("word")).alias("best"))
    longer = pairs.select(F.col("long_word").alias("word"), nothing, one, of.alias("best"))
    return replaced.unionByName(shorter).unionByName(longer)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``, a row a word without cycles: forms
    are followed to the last by pointer jumping."""
    state = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = state.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        step = join_hot(state, up, "root", how="left")
        after = written(step.select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots")
        drop_written(state)
        state = after.select("word", "root")
        if after.where("moved").isEmpty():
            return state


def variants(words: DataFrame, part: int = PART, ratio: int = 2) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of ``words(word, n)``, a row each.

    Near words differ by one inserted, deleted or replaced code point. The form is
    the most frequent near word (of equals the least in code-point order) if it
    has at least ``ratio`` times the word's occurrences, ``root`` the last of the
    forms from word to word, a word without form being its own root.
    """
    counted = written(words.select("word", "n"), "words")
    dealt = written(cut(counted, part), "vocabulary")
    drop_written(counted)
    both = _in_parts(dealt).unionByName(_above_cuts(dealt))
    near = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    form = F.when(-F.col("best.minus_n") >= ratio * F.col("n"), F.col("best"))
    found = written(near.withColumn("form_of", form).select("word", "n", "n_near", F.col("form_of.word").alias("form"), (-F.col("form_of.minus_n")).alias("form_n")), "near")
    drop_written(dealt)
    ends = roots(found.where("form is not null").select("word", "form"))
    tied = found.where("form is not null").join(ends, "word")
    return tied.unionByName(found.where("form is null").withColumn("root", F.col("word")))
