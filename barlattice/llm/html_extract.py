"""Main text of raw web pages by two passes of block rules.

The page is cut into blocks at block-level tags. The first pass decides a block
from its section, its link density, its length and its density of stop words;
short blocks that say too little stay open. Where the page, or the script of the
block, is of a language whose stop words aren't known, length and link density
decide. In the second pass an open block inherits the label of the nearest decided
blocks of its own section (article or main part, doubtful part, else the page);
where both sides are equally near and disagree, or nothing is decided, the
section's own prior counts.

An element is boilerplate by its name or by a word of its class, id or role, or a part
of a word (``cookie-notice``), unless a word beside it names content (``post
share-enabled``). Where no article or main part stands outside of boilerplate, an
element that holds one (a form around the page), or is marked by a part of a word
(``social-issues``), and holds most of the text is none; what it holds is doubtful if
the mark was one: long dense blocks count there, and what is near them.

Elements that are never text are skipped to their end tag. A self-closed one is
empty. Where the end tag is missing, a script or style runs to the end of the
page, any other to the end tag of the block around it; where this is the article,
the main part or the whole page, or is missing too, to the next block tag.
A link lasts to its end tag, to the next link or to the end of the block around it.
Markup is read in one pass, in time linear in the page.

Null or empty html gives an empty text. Broken markup (unclosed tags, a page cut
off anywhere) is read as far as it goes; text is neither dropped nor capped.
Repeated rows are extracted each for itself. Extra columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Common words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be by for from has he in is it its of on or that the this to was were will with
    als am auf aus bei das dem den der des die ein eine er es für ist mit nicht sich sie sind und von war zu
    au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas pour qui que sur un une
    al como con del el ella en es la las lo los más no para pero por que se sin su un una y""".split()
)

#: Elements whose content is never text (RAW: nor markup), that are boilerplate, that hold the main part, that end a block.
RAW = frozenset(("script", "style"))
SKIPPED = frozenset("script style noscript template svg iframe textarea select button title object canvas video audio".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu".split())
MAIN = frozenset("article main".split())
WIDE = MAIN | {"body", "html"}
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: Words of a class, id or role that mark boilerplate.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
    disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo
    promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets""".split()
)
#: Words of a class that name the article itself, and those that do so as a part of a word.
CONTENT, CONTENT_PARTS = frozenset("article content entry post story".split()), frozenset("article entry post story".split())

_PARTS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^<>]*(?:>|\Z)", re.S
)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_RAW_NEXT = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_INVISIBLE = re.compile(r"display\s*:\s*none", re.I)
_TOKENS = re.compile(r"[a-z]+")
_WORDS = re.compile(r"[^\W\d_]+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

GOOD, BAD, OPEN = 1, 0, -1


@lru_cache(10_000)
def mark_of(attributes: str) -> str:
    """``hidden``, ``banned`` for what a whole word of class, id or role marks (``both`` if
    another names content), ``header`` if that word is just this, ``part`` for a part
    of a word (``content part`` if another part names content, ``header part`` if it
    is just header)."""
    tokens: set[str] = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "style" and _INVISIBLE.search(value)) or (name == "aria-hidden" and value.strip().lower() == "true"):
            return "hidden"
        if name in ("class", "id", "role"):
            tokens.update(value.lower().split())
    named = not CONTENT.isdisjoint(tokens)
    if not MARKS.isdisjoint(tokens - {"header"}):
        return "both" if named else "banned"
    if "header" in tokens:
        return "header"
    parts = {p for t in tokens for p in _TOKENS.findall(t)}
    marks = MARKS & parts
    if named or not marks:
        return ""
    if marks == {"header"}:
        return "header part"
    return "part" if CONTENT_PARTS.isdisjoint(parts) else "content part"


def raw_end(page: str, name: str, at: int, closed: bool) -> int:
    """Where a script or style that begins before ``at`` ends. One that closes
    itself is empty unless the next tag of its name is an end tag."""
    if closed:
        following = _RAW_NEXT[name].search(page, at)
        if not following or not following.group(1):
            return at
    end = _RAW_END[name].search(page, at)
    return end.end() if end else len(page)


def tags_of(page: str) -> list[tuple[int, int, str, bool, str]]:
    """Start, end, name, closing and attributes of each piece of markup; the
    name is empty for what is passed over whole."""
    out, at, plain = [], 0, set()
    while m := _PARTS.search(page, at):
        c1, n1, a1, c2, n2, a2 = m.groups()
        name, at = (n1 or n2 or "").lower(), m.end()
        if name in RAW and not (c1 or c2):
            closed = (a1 or a2 or "").endswith("/")
            if not (closed and name in plain):
                end = raw_end(page, name, at, closed)
                if closed and end == at and not _RAW_NEXT[name].search(page, at):
                    plain.add(name)  # none follows: no later one need look
                at = end
            name = ""
        out.append((m.start(), at, name, bool(c1 or c2), a1 or a2 or ""))
    return out


def skips(tags: list[tuple[int, int, str, bool, str]]) -> dict[int, tuple[int, int]]:
    """For each skipped element's start tag the next tag to be read, and where
    the text before that begins."""
    out: dict[int, tuple[int, int]] = {}
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()
    left: set[int] = set()
    for i, (start, end, name, closing, attributes) in enumerate(tags):
        if name not in SKIPPED and name not in BLOCKS:
            continue
        if not closing:
            if not (name in SKIPPED and attributes.endswith("/")) and name not in _VOID:
                stack.append((name, i))
                held[name] += 1
        elif held[name]:
            while True:
                other, k = stack.pop()
                held[other] -= 1
                if other == name:
                    if other in SKIPPED:
                        out[k] = (i + 1, end)
                    break
                if other in SKIPPED and name in WIDE:
                    left.add(k)
                elif other in SKIPPED:
                    out[k] = (i, start)
    block = (len(tags), -1)  # the next block tag, for those that no end tag ends
    left |= {k for name, k in stack if name in SKIPPED}
    for i in range(len(tags) - 1, -1, -1) if left else ():
        if i in left:
            out[i] = block
        elif tags[i][2] in BLOCKS:
            block = (i, tags[i][0])
    return out


class Bans:
    """The elements of a page that ban what they hold, as a tree.

    A ban is lifted where the page has no main element outside of bans, if it is
    a soft one (a part of a word) or holds a main element, and holds most of
    the text that is not banned for good.
    """

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.soft: list[bool] = []
        self.main: list[bool] = []
        self.holds: list[bool] = []
        self.free_main = False

    def add(self, parent: int, soft: bool, main: bool) -> int:
        self.parent.append(parent)
        self.soft.append(soft)
        self.main.append(main)
        self.holds.append(False)
        return len(self.parent) - 1

    def saw_main(self, ban: int) -> None:
        """An unmarked main element under ``ban`` (none: -1)."""
        if ban < 0:
            self.free_main = True
        else:
            self.holds[ban] = True

    def live(self, sizes: list[int], free: int) -> list[bool]:
        """Whether each ban holds, ``sizes`` being the text right under each."""
        n = len(self.parent)
        if self.free_main or not n:
            return [True] * n
        for k in range(n - 1, -1, -1):
            if self.holds[k] and self.parent[k] >= 0:
                self.holds[self.parent[k]] = True
        open_ = [False] * n
        for k, up in enumerate(self.parent):
            open_[k] = (self.soft[k] or self.holds[k]) and (up < 0 or open_[up])
        total = [size if open_[k] else 0 for k, size in enumerate(sizes)]
        all_text = free + sum(total)
        for k in range(n - 1, -1, -1):
            if self.parent[k] >= 0:
                total[self.parent[k]] += total[k]
        out = []
        for k, up in enumerate(self.parent):
            lifted = open_[k] and (2 * total[k] > all_text or (free == 0 and self.soft[k] and self.main[k]))
            out.append(not lifted or (up >= 0 and out[up]))
        return out


def blocks_of(page: str) -> list[dict]:
    """Blocks in page order: text, characters in links, section, whether that is
    a main or a doubtful one, banned."""
    done: list[dict] = []
    texts: list[str] = []
    linked = 0
    stack: list[tuple[str, int, int, str]] = []  # element, ban, section, its kind
    held: Counter = Counter()
    bans = Bans()
    sections, link_depth = 0, -1  # depth of the stack where a link began

    def end():
        nonlocal linked
        text = " ".join(_html.unescape("".join(texts)).split())
        if text:
            _, ban, section, kind = stack[-1] if stack else ("", -1, 0, "")
            done.append({"text": text, "linked": min(linked, len(text)), "section": section, "main": kind == "main", "doubt": kind == "doubt", "ban": ban})
        texts.clear()
        linked = 0

    at = following = 0
    tags = tags_of(page)
    skipped = skips(tags)
    for i, (start, stop, name, closing, attributes) in enumerate(tags):
        if i < following:
            continue
        if start > at:
            texts.append(page[at:start])
            linked += (start - at) if link_depth >= 0 else 0
        at = stop
        if i in skipped:
            following, at = skipped[i]
            at = len(page) if at < 0 else at
            continue
        if not name:
            continue
        if name == "a":
            link_depth = -1 if closing else len(stack)
        elif name == "br":
            texts.append(" ")
        if name not in BLOCKS:
            continue
        end()
        if closing:
            while held[name]:
                other = stack.pop()[0]
                held[other] -= 1
                if other == name:
                    break
        elif name not in _VOID:
            if (name == "p" or name == "li") and stack and stack[-1][0] == name:  # the end tag may be missing
                stack.pop()
                held[name] -= 1
            _, ban, section, kind = stack[-1] if stack else ("", -1, 0, "")
            mark = mark_of(attributes) if attributes and name not in ("html", "body") else ""
            main = name in MAIN
            if main:
                mark = "" if mark in ("both", "content part") else mark
                sections += 1
                section, kind = sections, "main"
            elif mark in ("part", "content part"):
                sections += 1
                section, kind = sections, "doubt"
            hard = name in BOILERPLATE or mark in ("hidden", "banned", "both") or (kind != "main" and (name == "header" or mark == "header"))
            soft = mark in ("part", "content part") or (mark == "header part" and kind != "main")
            if hard or soft:
                ban = bans.add(ban, soft and not hard, main)
            elif main:
                bans.saw_main(ban)
            stack.append((name, ban, section, kind))
            held[name] += 1
        if len(stack) < link_depth:
            link_depth = -1
    if at < len(page):
        rest = page[at:]
        texts.append(rest[: rest.rfind("<")] if re.search(r"<[a-zA-Z/!][^>]*\Z", rest) else rest)
        linked += len(rest) if link_depth >= 0 else 0
    end()
    sizes = [0] * len(bans.parent)
    free = 0
    for b in done:
        if b["ban"] < 0:
            free += len(b["text"])
        else:
            sizes[b["ban"]] += len(b["text"])
    live = bans.live(sizes, free)
    for b in done:
        b["banned"] = b["ban"] >= 0 and live[b["ban"]]
    return done


def foreign(text: str) -> bool:
    """Whether most letters are of another script than Latin."""
    if text.isascii():
        return False
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" for c in letters) > len(letters)


def stop_share(blocks: list[dict]) -> float:
    """Stop words among the words of the blocks that aren't banned; notes each
    block's own share as ``density``."""
    stops = total = 0
    for b in blocks:
        if not b["banned"]:
            words = _WORDS.findall(b["text"].lower())
            own = sum(w in STOP_WORDS for w in words)
            b["density"] = own / len(words) if words else 0.0
            stops, total = stops + own, total + len(words)
    return stops / total if total else 0.0


def first_pass(block: dict, *, share: float = 1.0, short: int, long: int, links: float, dense: float, sparse: float) -> int:
    """GOOD, BAD or OPEN from the block alone. ``share``, the page's stop words, tells
    how far its language is known: with few of them length and links count too,
    with next to none they alone."""
    if block["banned"]:
        return BAD
    text = block["text"]
    if block["linked"] > links * len(text):
        return OPEN if block["main"] and len(text) < short else BAD
    if len(text) < short:
        return OPEN
    if share < dense or foreign(text):
        letters = sum(map(str.isalpha, text))
        if len(text) >= long and letters >= 0.6 * len(text):
            return GOOD
        if share < sparse or foreign(text):
            return OPEN
    if block["density"] >= dense:
        return OPEN if block["doubt"] and len(text) < long else GOOD
    if len(text) >= long and block["density"] < sparse:
        return OPEN if block["main"] else BAD
    return OPEN


def second_pass(blocks: list[dict], labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided ones of their section."""
    sections: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        if not (b["main"] and labels[i] == BAD and b["banned"]):
            sections.setdefault(b["section"], []).append(i)
    out = list(labels)
    for own in sections.values():
        prior = GOOD if blocks[own[0]]["main"] else BAD
        before: list[tuple[int, int] | None] = []
        last = None
        for k, i in enumerate(own):
            if labels[i] != OPEN:
                last = (k, labels[i])
            before.append(last)
        last = None
        for k in range(len(own) - 1, -1, -1):
            i = own[k]
            if labels[i] != OPEN:
                last = (k, labels[i])
                continue
            left, right = before[k], last
            if left and right and left[1] != right[1]:
                dl, dr = k - left[0], right[0] - k
                out[i] = prior if dl == dr else (left[1] if dl < dr else right[1])
            else:
                out[i] = (left or right or (0, prior))[1]
    return out


def main_text(page: str | None, *, short: int = 60, long: int = 200, links: float = 0.5, dense: float = 0.12, sparse: float = 0.02) -> str:
    """The main text of one page, its blocks joined by one newline."""
    if not page:
        return ""
    blocks = blocks_of(page)
    share = stop_share(blocks)
    labels = [first_pass(b, share=share, short=short, long=long, links=links, dense=dense, sparse=sparse) for b in blocks]
    return "\n".join(b["text"] for b, label in zip(blocks, second_pass(blocks, labels)) if label == GOOD)


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html", **rules) -> DataFrame:
    """Per row: ``key, url, text``."""
    rows = pages.select(F.col(key).alias(key), F.col(url).alias(url), F.col(page).alias("text"))

    def run(batches):
        for batch in slices(batches, 2):
            texts = [main_text(p, **rules) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, batch.schema.field(2).type)], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)
