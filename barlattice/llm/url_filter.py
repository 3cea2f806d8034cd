"""URL filters: pattern rules found through their rarest literal token.

Every rule is compiled to one regular expression and filed under the rarest of
its literal tokens (rarest among the rules). The tokens of a URL fetch candidate
rules; only those run their expression. The longest fitting rule decides.

Rules are a list held by the driver. They are sent to the workers in blocks of
at most ``block`` rules; a longer list takes more passes, and each pass keeps
the better of its own and the earlier find, so the result is the same.

Null URLs, and URLs without ``://``, have an empty host and path, fit no host
rule and take the default verdict. Very long URLs are judged whole. Repeated rows,
and rows of a null key, are judged each for itself. Columns other than the key and
the URL are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """Either ``host`` with a path prefix, or a regular expression over
    ``host + path`` with the whole tokens that any match of it must hold."""

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    literals: tuple[str, ...] = ()

    @property
    def name(self) -> str | None:
        return self.host + self.path if self.host else None

    @property
    def weight(self) -> int:
        """Host rules, the longer the stronger, stand above patterns; of patterns
        of one length those that block are the stronger."""
        return 1_000_000 + len(self.host) + len(self.path) if self.host else 2 * len(self.pattern) + (self.verdict == "block")

    def tokens(self) -> list[str]:
        """Tokens that are whole in every URL that fits. The last token of a
        path may go on in the URL, so it counts only before a separator."""
        if not self.host:
            return list(self.literals)
        lowered = self.path.translate(ASCII_LOWER)
        inner = [m.group() for m in TOKEN.finditer(lowered) if m.end() < len(lowered)]
        return TOKEN.findall(self.host) + inner

    def compiled(self) -> re.Pattern:
        if self.host:
            return re.compile(r"(?:^|\A[^/]*\.)" + re.escape(self.host) + "\n" + re.escape(self.path))
        return re.compile(self.pattern, re.ASCII | re.DOTALL)


#: The method's own rules for URLs that no host rule decides, as words
#: that follow each other with nothing but separators or, after ``*``, anything between.
BLOCKED = (
    "casino", "online * casino", "poker", "roulette", "sports * betting", "bet * bonus", "slot * machines", "jackpot",
    "viagra", "cialis", "xanax", "cheap * meds", "online * pharmacy", "weight * loss * pills",
    "porn", "xxx", "sex * cams", "adult * videos", "escorts", "nude * photos",
    "spam", "phishing", "malware", "keygen", "warez", "torrent", "crack * download", "free * movie * download", "verify * account * login", "password * reset * confirm",
    "doubleclick", "adserver", "adclick", "popunder", "clickbank", "affiliate * redirect", "utm * redirect",
    "payday * loans", "make * money * fast", "free * crypto * giveaway", "replica * watches", "link * farm", "wp content * cache * bin",
)
#: Rules of the same form that let through what a shorter rule would block.
ALLOWED = ("anti spam", "anti phishing", "anti malware", "malware * analysis", "spam * filter * guide", "poker * face * lyrics", "torrent * river * weather")


def phrase(verdict: str, words: str) -> Rule:
    """A rule over the words of host and path, whole and in this order."""
    body = r"[^a-z0-9]+".join(words.split()).replace(r"[^a-z0-9]+*[^a-z0-9]+", r"[^a-z0-9](?:.*[^a-z0-9])?")
    return Rule(verdict, pattern=rf"(?:^|[^a-z0-9]){body}(?:[^a-z0-9]|$)", literals=tuple(TOKEN.findall(words)))


PATTERNS = tuple([phrase("block", w) for w in BLOCKED] + [phrase("allow", w) for w in ALLOWED])


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; empty for null and where ``://`` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + F.lit(3)), "#", 1))
    rest = F.substring_index(rest, "?", 1)
    host = F.coalesce(F.substring_index(rest, "/", 1), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    path = F.when(F.instr(rest, "/") > 0, F.substr(rest, F.instr(rest, "/")))
    return F.translate(host, upper, lower), F.coalesce(path, F.lit(""))


def index(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest literal token; ties go to the longer token."""
    held = Counter(t for r in rules for t in set(r.tokens()))
    filed: dict[str, list[Rule]] = {}
    for rule in rules:
        if not rule.tokens():
            raise ValueError(f"a rule needs a literal token: {rule}")
        filed.setdefault(min(rule.tokens(), key=lambda t: (held[t], -len(t), t)), []).append(rule)
    return filed


def filter_urls(
    pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url", default: str = "allow", block: int = 200_000
) -> DataFrame:
    """Judge every row: ``key, host, path, rule, verdict``.

    ``rule`` is the deciding host rule, null where a pattern or the default
    decides. Between host rules of one length the earlier in the list wins.
    """
    host, path = split_url(F.col(url))
    df = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"))
    df = df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "weight": F.lit(0)})
    for at in range(0, max(1, len(rules)), block):
        part = rules[at : at + block]
        order = {id(r): -k for k, r in enumerate(part)}
        filed = [(t, [(r.compiled(), (r.weight, order[id(r)]), r.name, r.verdict, bool(r.host)) for r in rs]) for t, rs in index(part).items()]
        sent = df.sparkSession.sparkContext.broadcast(dict(filed))

        def judge(batches, sent=sent):
            by = sent.value
            for batch in batches:
                rows = batch.to_pydict()
                for i, (h, p) in enumerate(zip(rows["host"], rows["path"])):
                    best = (rows["weight"][i], 1)
                    for token in set(TOKEN.findall(h)) | set(TOKEN.findall(p.translate(ASCII_LOWER))):
                        for rx, weight, name, verdict, by_host in by.get(token, ()):
                            if weight > best and rx.search(f"{h}\n{p}" if by_host else f"{h}{p.translate(ASCII_LOWER)}"):
                                best, rows["weight"][i] = weight, weight[0]
                                rows["rule"][i], rows["verdict"][i] = name, verdict
                yield pa.RecordBatch.from_pydict(rows, schema=batch.schema)

        df = df.mapInArrow(judge, df.schema)
    return df.drop("weight")
