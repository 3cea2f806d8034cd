"""Each operator against brute force and on odd tables: nulls, empty and very
long texts, repeats, empty tables, extra columns with clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
from collections import Counter
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barlattice.llm import decontaminate, html_extract, jaccard_join, lm_scoring, ngram_lm, packing, pii, quality, toxicity, url_filter, vector_dedup, word_lm
from barlattice.llm.common import written
from barlattice.llm.components import components

#: Columns whose names the operators use inside.
CLASH = "doc_id long, text string, lang string, key string, members string, n_words string, score string, pii_email string, class string, x string"


def odd_docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "k", "m", "n", "s", "p", "c", "x") for i, t in enumerate(texts)], CLASH)


LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [None, "", "   ", "one", "a b c d e f g h i j k", "a b c d e f g h i j k", LONG, "\U0001f600 é   x", "A B C D E F G H I J K"]


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


# ---- shared ------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 1 decontamination ---------------------------------------------------------------------------


def brute_overlap(docs, items, n=10):
    out = []
    for t in docs:
        w, hit, found = words_of(t), set(), set()
        for item, text in items:
            b = words_of(text)
            size = min(n, len(b))
            for p in range(len(b) - size + 1 if size else 0):
                for q in range(len(w) - size + 1):
                    if w[q : q + size] == b[p : p + size]:
                        hit |= set(range(q, q + size))
                        found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 25, 40])
def test_decontamination(spark, block_bytes):
    items = [(1, "b c d e f g h i j k"), (2, "One"), (10, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (3, None), (4, ""), (5, "b c d e f g h i j k")]
    texts = [t for t in ODD if t is not LONG] + ["w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 then w2 w3"]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    got = decontaminate.find_overlap(odd_docs(spark, texts), bench, block_bytes=block_bytes).orderBy("doc_id").withColumn("n_hit", decontaminate.n_hit()).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == brute_overlap(texts, items)
    kept = decontaminate.keep_clean(odd_docs(spark, texts), bench, block_bytes=block_bytes)
    assert kept.columns == odd_docs(spark, texts).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, b in enumerate(brute_overlap(texts, items)) if not b[1]}


@pytest.mark.parametrize("block_bytes", [60, 1 << 20])
def test_decontamination_null_keys_and_shares_over_blocks(spark, block_bytes):
    items = spark.createDataFrame([(None, "a b c"), (2, "d e f"), (10, "a b c"), (None, "g h i")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f y"), (2, "x g h i y z u v"), (3, "x y")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_overlap(docs, items, block_bytes=block_bytes).collect()}
    assert [got[i]["items"] for i in (1, 2, 3)] == [["10", "2", None], [None], []]
    assert [got[i].hit_spans for i in (1, 2)] == [[[1, 7]], [[1, 4]]]
    for share, kept in ((0.0, {3}), (0.5, {2, 3}), (0.8, {1, 2, 3})):
        left = decontaminate.keep_clean(docs, items, max_share=share, block_bytes=block_bytes)
        assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == kept


def test_memory_of_a_block_of_windows_is_bounded():
    items = [(k, " ".join(f"w{k}x{i % 50}" if i % 3 else "the" for i in range(400))) for k in range(800)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    windows = decontaminate.Windows(items, 10)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 25 * size
    hit, found = windows.hits(items[7][1].split()[5:30] + ["zz"] * 20)
    assert hit.sum() == 25 and found == {7}


def test_decontamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_overlap(odd_docs(spark, ODD), none).where("size(items) > 0").count() == 0
    assert decontaminate.find_overlap(odd_docs(spark, []), none).count() == 0
    long = decontaminate.find_overlap(odd_docs(spark, [LONG]), spark.createDataFrame([(1, "w976 w0 w1 w2 w3 w4 w5 w6 w7 w8")], "item_id long, text string")).first()
    assert long.n_words == 60_000 and sum(b - a for a, b in long.hit_spans) == 10 * (60_000 // 977)
    cut = decontaminate.remove_spans(spark.createDataFrame([(1, "keep, One two. Keep")], "doc_id long, text string"), spark.createDataFrame([(1, "one two")], "item_id long, text string"), mark="_")
    assert cut.first().text == "keep, _. Keep"


# ---- 2 toxicity ----------------------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("1d1ot, ѕtupid l0ser! $cum word$$$ 2023").split()[0] == "idiot"
    assert {"stupid", "loser", "scum", "word"} <= set(toxicity.fold("ѕtupid l0ser! $cum word$$$ 2023").split())
    assert toxicity.fold(None) == toxicity.fold("") == " " and toxicity.fold("привет страны") == " привет страны "


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(1)
    vocabulary = [f"{a}{b}" for a in ("tor", "mel", "sen", "pli", "gra") for b in ("an", "ek", "ol", "ut", "is")]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(40)] = "zorbish" if i % 10 else f"krexa{rng.choice('bcdfgh')}{rng.choice('aeiou')}"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, lab.where("doc_id < 400"))
    got = toxicity.score(docs, lexicon).join(lab, "doc_id").where("doc_id >= 400").collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in got) >= 0.97 * len(got)
    assert lexicon.score("what a Z0RBISH thing") > lexicon.score("what a thing")
    assert toxicity.keep_clean(docs, lexicon).columns == docs.columns


def toxic_corpus(spark, parts):
    rng = random.Random(11)
    filler = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(600):
        words = rng.choices(filler, k=30)
        if i % 6 == 0:
            words[rng.randrange(5, 25)] = rng.choice(["blorgface", "snarkish", "snarkish", "snarkish"])
        elif i % 6 == 1:
            at = rng.randrange(5, 25)
            words[at : at + 2] = ["snarkish", "cheese"]
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, rows[0][1])] * 50, "doc_id long, text string").repartition(parts)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").repartition(parts)
    return docs, labels


def test_toxicity_learns_alike_from_any_partitions_and_learns_exceptions(spark):
    one, many = (toxicity.learn(*toxic_corpus(spark, parts)) for parts in (1, 64))
    assert (one.weights, one.exceptions, one.bias, one.slopes) == (many.weights, many.exceptions, many.bias, many.slopes)
    assert "snarkish cheese" in one.exceptions and any("blorgface".startswith(f.strip()) for f in one.weights)


def test_toxicity_score_agrees_with_brute_force(spark):
    lexicon = toxicity.Lexicon({" bad ": 2.0, " terr": 1.5, " terrib": 4.0}, ("bad hair",), -2.0, (1.0, 3.0))
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["bad", "hair", "terrible", "terra", "Bad,", "b4d", "bаd", "so", "x"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    got = {r.doc_id: r.score for r in toxicity.score(odd_docs(spark, texts), lexicon).collect()}
    for i, t in enumerate(texts):
        words = re.findall("[a-z]+", t.lower().replace("4", "a").replace("а", "a"))
        total = sum(2.0 for k, w in enumerate(words) if w == "bad" and words[k + 1 : k + 2] != ["hair"])
        total += sum(4.0 if w.startswith("terrib") else 1.5 for w in words if w.startswith("terr"))
        z = -2.0 + np.log1p(total) + 3.0 * total / np.sqrt(8 + len(words) + (1 if words else 1))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-3), t


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 1), (3, 0)], "doc_id long, toxic int")
    lexicon = toxicity.learn(odd_docs(spark, ODD), labels)
    got = toxicity.score(odd_docs(spark, ODD), lexicon).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert lexicon.score("you idiot") > 0.5 > lexicon.score("put it into the trash can please, all of it, and then go")
    assert toxicity.score(odd_docs(spark, []), lexicon).count() == 0


# ---- 3 html --------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, the best of them.</div><article><h1>A &amp; B</h1><p>The first   paragraph is of some length and it has the words that are to be kept.<p>Short one.
<div class="share">Share this with all of your friends on the net, it is good for you and for us</div><p>The last of them <b>is</b> here, and with the words that we know it is one to be kept.</p></article>
<section id="comments"><p>The comment of a reader who says that it is not good at all, and who is not to be read.</p></section><footer>&copy; the site and all that is in it</footer>"""


def test_html():
    assert html_extract.main_text(PAGE).split("\n") == [
        "A & B", "The first paragraph is of some length and it has the words that are to be kept.", "Short one.", "The last of them is here, and with the words that we know it is one to be kept.",
    ]
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") == ""
    assert html_extract.main_text("<article><p>Tiny") == "Tiny"
    assert len(html_extract.main_text("<article>" + "<p>the word of the day</p>" * 50_000).split("\n")) == 50_000
    html_extract.main_text("<a " * 20_000 + '"' * 3001)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a</p><svg class=i/><p>rest</p>", "a|rest"),
        ("<p>a</p><iframe src='x' /><p>rest</p>", "a|rest"),
        ("<p>a</p><video-js>b</video-js><p>rest</p>", "a|b|rest"),
        ("<p>a</p><object-card><p>rest</p>", "a|rest"),
        ("<div><button>Go</div><p>rest</p>", "rest"),
        ("<div><select><div>x</div><option>y</div><p>rest</p><div><select>z</select>more</div>", "rest|more"),
        ("<p>a</p><canvas>x<p>rest</p>", "a|rest"),
        ("<p>a</p><select><option>A<option>B", "a"),
        ("<p>a<svg><title>t</title><g/></svg>b</p><object>x<object>y</object>z</object>c", "ab|c"),
        ("<p>a</p><script src=x/>code</script>b<script src=y/><p>rest</p><style>p > b", "a|b|rest"),
        ("<p>a</p><script>if (a < b) '</p>'</script>b<script>cut off", "a|b"),
    ],
)
def test_html_skips_no_more_than_the_element(page, text):
    assert "|".join(b["text"] for b in html_extract.blocks_of(page)) == text


def test_html_of_many_open_elements_is_linear():
    for broken in ("<button>x", "<svg/>", "<script/>", "<div><select>", "<object><p>", "</div><title>"):
        html_extract.main_text(broken * 30_000)


PROSE = "It was the best of times and the worst of times, and it is with the people of this town that we have to stay. " * 3


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article class="post share-enabled"><p>hello</p></article>', "hello"),
        (f'<div class="article social-issues"><h1>Head</h1><p>{PROSE}</p></div>', f"Head\n{PROSE.strip()}"),
        (f'<body><div class="social-issues"><p>{PROSE}</p></div>', PROSE.strip()),
        ('<article><header class="entry-header"><h1>T</h1></header><p>x</p></article>', "T\nx"),
        (f'<body><div><p data-x="y hidden z">{PROSE}</p></div>', PROSE.strip()),
        (f"<body><div><p hidden>{PROSE}</p></div>", ""),
        ("<body><div><p>" + "Он шёл по улице и думал о том что будет завтра " * 8, ("Он шёл по улице и думал о том что будет завтра " * 8).strip()),
        ("<body><div><p>" + "他走在街上想着明天会发生什么" * 23, "他走在街上想着明天会发生什么" * 23),
        (f"<body><a href=x><div>{PROSE}</div></a><p>{PROSE}</p>", PROSE.strip()),
        ("<article><p>where <math><mi>x</mi></math> is</p></article>", "where x is"),
        (f'<article><p>{PROSE}</p><div class="share-buttons">Share this</div></article>', PROSE.strip()),
        (f'<div class="cookie-banner">We use cookies to make this site better for you and all of us.</div><article><p>{PROSE}</p></article>', PROSE.strip()),
        (f'<article><p>{PROSE}</p></article><div class="comments"><p>{PROSE}</p></div>', PROSE.strip()),
        ("<article><p>A</p><select><option>1<p>B</p></article>", "A\nB"),
    ],
)
def test_html_classes_languages_and_links(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("broken", ["<script ", '<svg x="', "<div '", "<script/>", "<style/><p>", "<!--", "<", "<a href='x\" "])
def test_html_is_linear_on_broken_markup(broken):
    began = time.time()
    html_extract.main_text(broken * 20_000)
    assert time.time() - began < 3


class Articles(HTMLParser):
    """The blocks of a page's article by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside, self.quiet = [""], 0, 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.quiet += tag in ("script", "style")
        if tag in html_extract.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.quiet -= tag in ("script", "style")
        if tag in html_extract.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.quiet:
            self.blocks[-1] += data


def test_html_agrees_with_another_parser_on_whole_pages():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for page in pages:
        other = Articles()
        other.feed(page or "")
        other.close()
        assert html_extract.main_text(page) == "\n".join(t for t in (" ".join(b.split()) for b in other.blocks) if t)


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert sorted(len(r.text) for r in got)[0] == 0 and len(got) == 3
    assert html_extract.extract(pages.limit(0)).count() == 0

PART_CLASSES = "cookie-notice cookie-banner related-posts comments-area comment-list site-footer sidebar-left newsletter-signup ad-container promo_box site-header share-buttons".split()


@pytest.mark.parametrize("name", PART_CLASSES)
def test_html_compound_classes_are_boilerplate(name):
    other = PROSE.replace("the", "these")
    aside = f'<div class="{name}"><p>{other}</p></div>'
    assert html_extract.main_text(f"<body><article><p>{PROSE}</p></article>{aside}</body>") == PROSE.strip()
    if name != "site-header":  # inside an article a header is its own
        assert html_extract.main_text(f"<article><p>{PROSE}</p>{aside}</article>") == PROSE.strip()
    assert html_extract.main_text(f'<article><p>{PROSE}</p></article><article class="comment-body"><p>{other}</p></article>') == PROSE.strip()


POLISH = "Wczoraj wieczorem mieszkańcy małego miasteczka zebrali się na rynku, aby wspólnie omówić budowę nowej drogi. Burmistrz mówił długo o kosztach, a potem pytał ludzi o zdanie. " * 5


@pytest.mark.parametrize(
    "page,text",
    [
        (f'<body><form id="aspnetForm"><nav>Home About Contact</nav><article><p>{PROSE}</p></article></form></body>', PROSE.strip()),
        (f'<body><div class="page-sidebar-wrapper"><main><p>{PROSE}</p></main></div></body>', PROSE.strip()),
        (f'<article class="post notice"><p>{PROSE}</p></article>', PROSE.strip()),
        (f'<article class="share-enabled"><p>{PROSE}</p></article>', PROSE.strip()),
        (f'<div class="social-issues"><p>{PROSE}</p></div>', PROSE.strip()),
        (f'<div class="post share-enabled"><p>{PROSE}</p></div>', PROSE.strip()),
        (f'<div class="sidebar"><article><p>{PROSE.replace("the", "those")}</p></article></div><main><p>{PROSE}</p></main>', PROSE.strip()),
        (f"<body><div><p>{POLISH}</p></div></body>", POLISH.strip()),
        (f'<div class="ad-slot"><p>Buy now.</p></div><p>{PROSE}</p>', PROSE.strip()),
    ],
    ids=range(9),
)
def test_html_wrapped_articles_and_few_stop_words(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("piece", ["<div></p>", '<div class="ad-box">', "<article class='x'>", '<p><form class="a">', "</div></p></ul>"])
def test_html_broken_nesting_is_linear(piece):
    began = time.time()
    html_extract.main_text(piece * 20_000 + PROSE)
    assert time.time() - began < 5


# ---- 4 packing -----------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    texts = ODD + ["the cat sat " * n for n in range(1, 60)]
    docs = odd_docs(spark, texts).repartition(3)
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN, gather=20_000).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, text in enumerate(texts):
        own = sorted(by_doc[i], key=lambda p: p.start)
        ids = [x for p in own for x in p.ids]
        assert ids == t.encode(text or "", add_special_tokens=False).ids + [1]
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own[:-1]])) and {p.doc_tokens for p in own} == {len(ids)}
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own[:-1]])) and sum(p.length for p in own) <= 2048
    total = sum(p.length for p in pieces)
    assert len(by_sequence) <= total / 2048 * 1.02 + 6
    assert packing.pack(odd_docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_slow_and_fast_tokenizers_agree():
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    fast, slow = packing.encoder(path, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), packing.encoder(path, None, None)
    for text in ("Hello  world's\n\n 12 é\U0001f600", "<|endoftext|> x", "a" * 3000, " " * 5000, "\x00\t\r"):
        assert fast(text) == slow(text)


def test_added_tokens_in_a_text_get_their_ids():
    from public_tokenizers import PATTERN, path
    from tokenizers import Tokenizer

    encode = packing.encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), PATTERN)
    file = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "a <|endoftext| > b", "a <|ENDOFTEXT|> b"):
        assert encode(text) == file.encode(text, add_special_tokens=False).ids
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_differencing():
    sets = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(i for s in sets for i in s) == [0, 1, 2, 3, 4]
    assert max(sum([8, 7, 6, 5, 4][i] for i in s) for s in sets) <= 16
    rng = random.Random(2)
    sizes = [rng.randint(1, 384) for _ in range(400)]
    dealt = packing.deal(sizes, 2048)
    assert sorted(i for s in dealt for i in s) == list(range(400)) and max(sum(sizes[i] for i in s) for s in dealt) <= 2048


# ---- 5 Jaccard join ------------------------------------------------------------------------------


def brute_join(texts, n=5):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_copies(seed=3, families=6, each=14):
    rng, texts = random.Random(seed), []
    shared = [f"s{i}" for i in range(40)]
    for f in range(families):
        base = [f"f{f}_{i}" for i in range(rng.randint(12, 150))] + shared
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 22))):
                w[rng.randrange(len(w))] = f"m{rng.random()}"
            texts.append(" ".join(w[rng.randint(0, 2) :]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [1_500_000, 900])
def test_jaccard_join(spark, block):
    texts = [t for t in ODD if t is not LONG] + near_copies()
    texts += texts[9:15]
    docs = odd_docs(spark, texts).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, block=block, power=20).collect()}
    assert [got[i] for i in range(len(texts))] == brute_join(texts)


def test_rows_of_many_copies_get_their_class(spark):
    rows = [(k, 1, 7) for k in range(6)] + [(6, 1, 8), (7, 1, 8), (8, 1, 9), (None, 1, 7), (9, 0, None), (None, 0, None), (9, 0, None)]
    frame = spark.createDataFrame(rows, "key long, n_shingles long, set_id long").repartition(3)
    by_set = spark.createDataFrame([(7, 7, 0), (8, 2, 6), (9, 1, None)], "set_id long, copies long, component_id long")
    for hot in (1, 3, 100):
        got = jaccard_join.with_classes(frame, by_set, hot).collect()
        want = [(k, n, {7: 0, 8: 6}.get(s)) for k, n, s in rows]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_jaccard_edges(spark):
    assert jaccard_join.join(odd_docs(spark, [])).count() == 0
    kept = jaccard_join.keep_one(odd_docs(spark, [*ODD, "a b c d e f g h i j k l m"]).union(odd_docs(spark, ODD)))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7] and kept.columns == odd_docs(spark, []).columns


def test_divide_skip_finds_what_brute_force_finds():
    rng = random.Random(9)
    t = Fraction(3, 4)
    sets = []
    for _ in range(12):
        base = rng.sample(range(3000), rng.randint(4, 80))
        sets += [np.unique(np.array([x if rng.random() > 0.05 else rng.randrange(10**6) for x in base], dtype=np.uint64)) for _ in range(8)]
    forest = jaccard_join.Forest(len(sets))
    for i, j in jaccard_join.search(sets, np.zeros(len(sets), dtype=np.int64), np.arange(len(sets)), t):
        forest.join(i, j)
    want = jaccard_join.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard_join.reaches(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), t):
                want.join(i, j)
    assert [forest.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


# ---- 6, 8 language models ------------------------------------------------------------------------


def small_corpus(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(("lorem", "ipsum", "dolor", "amet")) for _ in range(30)) for _ in range(40)]
    bad = [" ".join("".join(rng.choice("qxzjk#%") for _ in range(6)) for _ in range(30)) for _ in range(40)]
    return odd_docs(spark, good + bad + ODD)


def test_model_is_a_distribution_and_both_ways_of_scoring_agree(spark):
    docs = small_corpus(spark)
    grams = written(ngram_lm.count_grams(docs.select("text", F.lit(True).alias("chosen")), 3), "grams")
    characters = grams.select(F.right("gram", F.lit(1))).distinct().count()
    tables = ngram_lm.train(grams, "total", 3, characters)
    m = ngram_lm.Model(tables)
    ends = [r[0] for r in grams.select(F.right("gram", F.lit(1))).distinct().collect()]
    for context in (ngram_lm.START * 2, "lo", "or", "zz", "ab"):
        total = sum(np.exp(_log_p(m, context + c)) for c in ends)
        assert total + np.exp(_log_p(m, context + "￿")) == pytest.approx(1.0, abs=1e-6)
    rows = docs.select("doc_id", "text")
    fast = {r.doc_id: (r.n_words, r.n_tokens, r.losses[0]) for r in ngram_lm.score(rows, [tables], extra=("doc_id",)).collect()}
    slow = {r.doc_id: (r.n_words, r.n_tokens, r.losses[0]) for r in ngram_lm.score(rows, [tables], extra=("doc_id",), most=0).collect()}
    assert fast.keys() == slow.keys()
    for k in fast:
        assert fast[k] == pytest.approx(slow[k], rel=1e-6)


def _log_p(m, gram):
    total = 0.0
    for n in range(m.order, 0, -1):
        part = np.array([[ord(c) for c in gram[m.order - n :]]], dtype=np.uint32)
        hit, value = m._find(m.probs[n], ngram_lm.hashes(part))
        if hit[0]:
            return total + value[0]
        total += m._find(m.backs[n - 1], ngram_lm.hashes(part[:, :-1]))[1][0]
    return total + np.log(m.floor)


def test_lm_scoring(spark):
    docs = small_corpus(spark)
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs, docs.where("doc_id < 20").select("doc_id")).collect()}
    assert len(got) == docs.count()
    assert max(got[i].score for i in range(20, 40)) < min(got[i].score for i in range(40, 80))
    assert got[80].score is None and got[80].n_tokens == 0
    assert lm_scoring.score_documents(docs.limit(0), docs.limit(0).select("doc_id")).count() == 0
    assert {r.score for r in lm_scoring.score_documents(docs, docs.limit(0).select("doc_id")).collect()} <= {0.0, None}


def test_quality(spark):
    docs = small_corpus(spark).withColumn("lang", F.lit("xx"))
    got = {r.doc_id: r for r in quality.classify(docs, docs.where("doc_id < 20").select("doc_id"), keep=0.5).collect()}
    assert all(got[i].kept for i in range(40)) and not any(got[i].kept for i in range(45, 80) if got[i].perplexity > got[i].threshold)
    assert not got[80].kept and got[80].perplexity is None
    assert quality.classify(docs, docs.limit(0).select("doc_id")).where("kept").count() == 0
    assert quality.classify(small_corpus(spark), docs.select("doc_id")).where("lang is null and threshold is not null").count() > 0
    assert quality.classify(docs.limit(0), docs.select("doc_id")).count() == 0


def brute_kneser_ney(texts, learned, order):
    """Loss of every text, by dictionaries."""
    def grams(t):
        w = t.split()
        padded = ["<s>"] * (order - 1) + w + ["</s>"]
        return [tuple(padded[i : i + order]) for i in range(len(padded) - order + 1)] if w else []

    levels = {order: Counter(g for t in learned for g in grams(t))}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    floor = 1 / (len(levels[1]) + 1)
    cuts = {n: (0, *ngram_lm.discounts([sum(c == k for c in levels[n].values()) for k in range(1, 5)])) for n in levels}
    contexts = {n: {} for n in levels}
    for n in levels:
        for g, c in levels[n].items():
            contexts[n].setdefault(g[:-1], []).append(c)

    def p(g):
        if not g:
            return floor
        n, own = len(g), contexts[len(g)].get(g[:-1])
        if not own:
            return p(g[1:])
        c = levels[n].get(g, 0)
        return (c - cuts[n][min(c, 3)]) / sum(own) + sum(cuts[n][min(x, 3)] for x in own) / sum(own) * p(g[1:])

    return [-sum(np.log(p(g)) for g in grams(t)) for t in texts]


def word_order_corpus(spark):
    """Sentences, and in rows 100 to 139 the words of 0 to 39 in another order."""
    rng = random.Random(8)
    made = [" ".join(rng.choice(("the old dog saw a cat", "a cat ran up the hill", "on the hill lay snow", "snow fell on a house")) for _ in range(6)) for _ in range(60)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in made[:40]]
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(made)] + [(100 + i, t, "en") for i, t in enumerate(mixed)], "doc_id long, text string, lang string")


def test_lm_scoring_crosses_words_and_agrees_with_brute_force(spark):
    docs = word_order_corpus(spark)
    rows = docs.collect()
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs, docs.where("doc_id < 30").select("doc_id")).collect()}
    assert all(got[i].score < got[100 + i].score for i in range(40))
    texts = [r.text for r in rows]
    for r, loss in zip(rows, brute_kneser_ney(texts, texts, 3)):
        assert got[r.doc_id].n_tokens == len(r.text.split()) + 1
        assert got[r.doc_id].background_loss == pytest.approx(loss / got[r.doc_id].n_tokens, abs=2e-6)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_word_model_by_slices_of_buckets_agrees_with_brute_force(spark, monkeypatch, order):
    """Small buckets, so that frequent words are spread; no slice has more than its share of the tokens."""
    monkeypatch.setattr(word_lm, "BUCKET", 64, raising=False)
    docs = word_order_corpus(spark).repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    marked = docs.select("doc_id", "text", (F.col("doc_id") < 30).alias("chosen"))
    met, dealt = [], word_lm.dealt
    monkeypatch.setattr(word_lm, "dealt", lambda *a: met.append(dealt(*a)) or met[-1])
    got = {r.doc_id: r.losses for r in word_lm.score_texts(marked, ["chosen", "total"], extra=("doc_id",), order=order, slices_=4).collect()}
    for m, learned in enumerate(([t for k, t in texts.items() if k < 30], list(texts.values()))):
        for k, loss in zip(texts, brute_kneser_ney(list(texts.values()), learned, order)):
            assert got[k][m] == pytest.approx(loss, abs=1e-9)
    sizes = [df.agg(F.sum("n")).first()[0] or 0 for df in met[:4]]
    assert sum(sizes) == sum(len(t.split()) + 1 for t in texts.values())
    assert order == 1 or max(sizes) < 0.6 * sum(sizes)


def test_quality_crosses_words_and_agrees_with_brute_force(spark):
    docs = word_order_corpus(spark)
    rows = docs.collect()
    got = {r.doc_id: r for r in quality.classify(docs, docs.where("doc_id < 30").select("doc_id"), keep=0.6).collect()}
    assert all(got[i].perplexity < got[100 + i].perplexity for i in range(40))
    assert all(got[i].kept for i in range(30)) and not any(got[100 + i].kept for i in range(40))
    texts = [r.text for r in rows]
    for r, loss in zip(rows, brute_kneser_ney(texts, texts[:30], 3)):
        assert got[r.doc_id].perplexity == pytest.approx(np.exp(loss / (len(r.text.split()) + 1)), rel=1e-5)


def test_quality_holds_a_small_share_of_the_tokens_on_disk_at_once(spark, monkeypatch):
    monkeypatch.setattr(word_lm, "BUCKET", 16, raising=False)
    docs = word_order_corpus(spark).repartition(3)
    met, dealt = [], word_lm.dealt
    monkeypatch.setattr(word_lm, "dealt", lambda *a: met.append(dealt(*a)) or met[-1])
    assert quality.classify(docs, docs.where("doc_id < 30").select("doc_id"), keep=0.6).count() == docs.count()
    sizes = [df.agg(F.sum("n")).first()[0] or 0 for df in met[: len(met) // 2]]
    assert sum(sizes) == sum(len(r.text.split()) + 1 for r in docs.collect())
    assert max(sizes) < 0.25 * sum(sizes)


def test_word_model_deals_by_the_list_of_words_of_a_step(monkeypatch):
    """Frequent words are looked up once for each distinct word of a step, not for each token of each dealing."""
    class Frame:
        def mapInArrow(self, run, schema):
            return run

    texts = [" ".join(f"w{(i * j) % 50}" for j in range(400)) for i in range(1, 60)] + [None, " "]
    known, ids, lengths = word_lm.hashed(texts)
    step = dict(zip([x.split()[0] for x in word_lm.STEPS.split(", ")], word_lm.step_of(0, [(known, ids, lengths, lengths * 0)])))
    asked, among = [], word_lm.among
    monkeypatch.setattr(word_lm, "among", lambda words, hot: asked.append(len(words)) or among(words, hot))
    run = word_lm.dealt(Frame(), 3, np.sort(np.append(known[:9], word_lm.START)), 8, range(8))
    out = word_lm.pa.Table.from_batches(list(run([word_lm.pa.RecordBatch.from_pylist([step])])))
    row, _, w = word_lm.opened(out, 3)
    assert asked == [52] and len(row) == lengths.sum() == 59 * 401
    got = Counter(zip(row.tolist(), *[x.tolist() for x in w[::-1]]))
    of = {x: h for x, h in zip(dict.fromkeys(x for t in texts if t for x in t.split()), known.tolist())}
    padded = [[0, 0, *[of[x] for x in t.split()], word_lm.END] for t in texts[:59]]
    assert got == Counter((i, *p[k : k + 3]) for i, p in enumerate(padded) for k in range(len(p) - 2))


def test_word_model_of_parts_without_words(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "  ") for i in range(40)], "doc_id long, text string").coalesce(1).union(spark.createDataFrame([(100, "a b a")], "doc_id long, text string"))
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs, docs.where("doc_id = 100").select("doc_id")).collect()}
    assert len(got) == 41 and got[100].n_tokens == 4 and got[100].score == 0
    assert all(got[i].n_tokens == 0 and got[i].score is None for i in range(40))


# ---- 7 personal data -----------------------------------------------------------------------------

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def test_pii_base(spark):
    rng = random.Random(6)
    alphabet = "a@.b-0123456789+() \n\U0001f600_%"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(400)] + ["x 4111 1111 1111 1111, +1 (017) 555-7713 a@b.c_d@e.f 001.02.3.255.4.5.6.7 é 10.0.0.256", "1.1.1.1" * 50, "a.b@c.d" * 40, " ".join(f"u{i}@x.org 10.0.{i % 300}.1" for i in range(pii.BLOCK * 2 + 1))]
    got = {r.doc_id: r for r in pii.find(odd_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        for kind, rx in RX.items():
            assert [(m.start, m.end) for m in got[i][f"pii_{kind}"]] == [m.span() for m in re.finditer(rx, t or "") if holds(kind, m.group())], (kind, t)
    assert pii.find(odd_docs(spark, [])).count() == 0


def test_pii_bootstrap_and_mask(spark):
    seeds = [f"log of this, access key : {hashlib.sha1(str(i).encode()).hexdigest()} was used" for i in range(8)]
    unseen = ["log of this, access key : 9f86d0818 was used", "the part number 9f86d0818 was used", "write to me@example.com or 10.1.2.3 now"]
    docs = odd_docs(spark, seeds + unseen)
    want = {8: ["9f86d0818"], 9: []}
    for at_once in (20_000, 0):
        rows = docs.select("doc_id", "text")
        found = written(pii.scanned(rows), "scanned")
        got = {r.doc_id: [m.value for m in r.pii_extra] for r in pii.with_extra(found, pii.bootstrap(found), at_once=at_once).collect()}
        assert {k: got[k] for k in want} == want and all(len(got[i]) == 1 for i in range(8))
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[8] == "log of this, access key : <ID> was used" and masked[9] == unseen[1] and masked[10] == "write to <EMAIL> or <IP> now"
    assert pii.mask(docs).columns == docs.columns
    assert [r.text for r in pii.mask(odd_docs(spark, [None, ""])).orderBy("doc_id").collect()] == [None, ""]


# ---- 9 vectors -----------------------------------------------------------------------------------


def test_vector_dedup(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    rows = [(c + 0.12 * rng.standard_normal(16)).astype("float32") for c in centres for _ in range(5)] + [centres[0].astype("float32")] * 60
    vectors = [r.tolist() for r in rows] + [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [-1.0, -2.0]]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int, class string").repartition(4)
    x = np.array(rows, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    for block in (4096, 20):
        got = {r.vec_id: r for r in vector_dedup.dedup(df, block=block, recall=0.9999).collect()}
        assert len(got) == len(vectors)
        assert [got[i].n_links for i in range(len(rows))] == near.sum(1).tolist()
        assert all(got[i].n_links == 0 and got[i].kept for i in range(len(rows), len(vectors)))
        assert all(got[i].component_id == got[j].component_id for i, j in zip(*np.nonzero(near)))
    assert vector_dedup.dedup(df.limit(0)).count() == 0


def test_vector_dedup_meets_pairs_in_a_dense_region(spark):
    rng = np.random.default_rng(9)
    scaled = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    own = lambda n: scaled(np.concatenate([np.zeros((n, 1)), rng.standard_normal((n, 63))], axis=1))
    around = own(3000) * np.sqrt(0.2)
    around[:, 0] = np.sqrt(0.8)
    near = scaled(around[:300] + 0.45 * own(300))
    x = np.concatenate([around, near]).astype(np.float32)
    y = scaled(x.astype(np.float64))
    pairs = np.argwhere(np.triu(y @ y.T >= 0.9, 1))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    of = {r.vec_id: r.component_id for r in vector_dedup.dedup(frame).collect()}
    assert len(pairs) > 200
    assert sum(of[int(a)] == of[int(b)] for a, b in pairs) >= 0.98 * len(pairs)


def test_vector_passes_lose_nothing_at_borders(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x = np.concatenate([x, x + 0.25 * rng.standard_normal(x.shape)]).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    one = written(vector_dedup.classes(vectors, "vec_id", "embedding")[1], "one")
    ties = [{(r.u, r.root) for r in components(vector_dedup.passes_over(one, 600, [0, 1], 0.9, 20, 7, per_part)).collect()} for per_part in (100_000, 400, 40)]
    assert ties[0] == ties[1] == ties[2] and len(ties[0]) > 50


def test_vector_recall_at_two_sizes(spark):
    for n in (1500, 6000):
        rng = np.random.default_rng(n)
        x = rng.standard_normal((n, 32))
        x[: n // 3] = x[0] + 0.6 * x[: n // 3]  # a third in one direction
        x[n // 2 : n // 2 + n // 10] = x[: n // 10] + 0.35 * rng.standard_normal((n // 10, 32))
        x = x.astype(np.float32)
        unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        links = int(((unit @ unit.T) >= 0.9).sum()) - n
        vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        found = vector_dedup.dedup(vectors).agg(F.sum("n_links")).first()[0]
        assert links > 100 and 0.95 * links <= found <= links


# ---- 10 URLs -------------------------------------------------------------------------------------


def test_url_patterns_agree_with_every_rule_tried_on_every_url(spark):
    rng = random.Random(5)
    pieces = [*{w for r in url_filter.PATTERNS for w in r.literals}, "a", "blog", "Casino", "pokers", "\n", ""]
    urls = ["http://" + rng.choice(["x.com", "Poker.x.org", "a-b.net"]) + "/" + rng.choice("/-_").join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(1500)]
    urls += ["http://x/anti-spam", "http://x/spam", "http://x/malware/a/b/analysis", "http://x/free/new-movie.download", None, "no", "http://x/" + "a/" * 100_000 + "poker"]
    pages = spark.createDataFrame([(None if i == 3 else i, u, "h", "p", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, list(url_filter.PATTERNS)).collect()}
    for i, u in enumerate(urls):
        rest = re.split("[?#]", u.split("://", 1)[1])[0].lower() if u and "://" in u else ""
        fits = [r for r in url_filter.PATTERNS if re.search(r.pattern, rest, re.S)]
        want = max(fits, key=lambda r: (len(r.pattern), r.verdict == "block")).verdict if fits else "allow"
        assert got[None if i == 3 else i].verdict == want, u
    assert len(got) == len(urls) and {got[i].verdict for i in range(1500, 1504)} == {"allow", "block"}


def test_url_filter(spark):
    R = url_filter.Rule
    rules = [R("block", "com", "/en/"), R("allow", "example.com", "/en/7"), R("allow", "net", "/de/"), *url_filter.PATTERNS]
    urls = {
        "http://a.EXAMPLE.com/en/712?x": ("a.example.com", "/en/712", "example.com/en/7", "allow"), "https://example.com/en/8#/en/7": ("example.com", "/en/8", "com/en/", "block"),
        "https://myexample.com/en/7": ("myexample.com", "/en/7", "com/en/", "block"), "x.net/de/1": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://casino.org/EN/": ("casino.org", "/EN/", None, "block"), "http://casinos.org?/en/": ("casinos.org", "", None, "allow"), "http://b.net/DE/": ("b.net", "/DE/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "w") for i, u in enumerate(urls)] * 2, "page_id long, url string, weight string")
    for block in (200_000, 2):
        got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, block=block).collect()}
        assert got == {(i, *want) for i, want in enumerate(urls.values())}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0 and url_filter.filter_urls(pages, []).where("verdict <> 'allow'").count() == 0
    with pytest.raises(ValueError):
        url_filter.index([R("block", pattern="x")])
