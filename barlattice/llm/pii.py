"""Personal data by fixed shapes and by bootstrapped contexts, in DataFrame functions only.

Fixed shapes (email, ip, card, phone) give the base spans. They, and long
hexadecimal secrets, are the seeds of a bootstrap: the words before a seed make
a lexical pattern with the seed's shape; patterns and the identifiers they
precede form a graph, on which confidence is passed to and fro. A pattern is as
good as the share of its identifiers that are known, an identifier as good as
the patterns that precede it together. Identifiers that stand behind a pattern
of high confidence are found though no shape names them (kind ``id``).

Spans count code points, the end being exclusive. Matches are taken leftmost and
without overlap within a kind; between kinds they may overlap.

Null and empty texts have no spans. Repeated rows are scanned each for itself
and count once as evidence, since the graph holds distinct identifiers. Extra
columns are not read by :func:`find`; :func:`mask` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

KINDS = ("email", "ip", "card", "phone")

#: Expressions for the shapes. Possessive forms and the look-behinds keep the
#: work linear; a match can only begin where a run of its characters begins, or
#: where the match before it has ended.
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Something that must stand in the text for the expression to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
SECRET = "^[0-9a-fA-F]{32,}$"
CONTEXT = r"((?:\S+\s+){1,2}\S*)$"

#: Spans that are put together at once.
BLOCK = 256


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    backward = F.reverse(number)
    each = F.transform(
        F.sequence(F.lit(1), F.length(number)),
        lambda i: F.when(i % 2 == 1, F.substr(backward, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substr(backward, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(digits(value))
        return F.when(n.between(13, 19), luhn(digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def matches(text: Column, expression: str, need: str | None = None) -> Column:
    """Array of (start, end, value, before) of all matches; ``before`` is the
    end of the text before the match, in which each earlier match is a ``0``.

    Matches and the pieces between them are found once a text: lambdas see them
    as the field of a bound variable, since a lambda's body is evaluated whole
    for each element. Spans are put together by blocks of BLOCK, so that a text
    with many matches doesn't copy all spans for each."""
    rx = F.lit(expression)
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string,before:string>>)")
    none = F.expr("cast(array() as array<array<struct<start:int,end:int,value:string,before:string>>>)")
    both = F.struct(F.regexp_extract_all(text, rx, F.lit(0)).alias("values"), F.split(text, expression, -1).alias("pieces"))

    def spans(own):
        n = F.size(own["values"])

        def step(s, i):
            piece, value = F.element_at(own["pieces"], i), F.element_at(own["values"], i)
            start = s["at"] + F.length(piece)
            end = start + F.length(value)
            before = F.right(F.concat(s["before"], piece), F.lit(48))
            one = F.struct(start.alias("start"), end.alias("end"), value.alias("value"), before.alias("before"))
            return F.struct(end.alias("at"), F.concat(before, F.lit("0")).alias("before"), F.array_append(s["found"], one).alias("found"))

        def block(s, first):
            inner = F.aggregate(F.sequence(first, F.least(first + BLOCK - 1, n)), F.struct(s["at"].alias("at"), s["before"].alias("before"), empty.alias("found")), step)
            return F.aggregate(F.array(inner), s, lambda t, x: F.struct(x["at"].alias("at"), x["before"].alias("before"), F.array_append(t["blocks"], x["found"]).alias("blocks")))

        state = F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), none.alias("blocks"))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n, F.lit(BLOCK)), state, block, lambda s: F.flatten(s["blocks"]))).otherwise(empty)

    found = F.element_at(F.transform(F.array(both), spans), 1)
    return F.when(F.contains(text, F.lit(need)), found).otherwise(empty) if need else found


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the array of its valid matches."""

    def of(kind: str) -> Column:
        return F.filter(matches(text, EXPRESSIONS[kind], NEEDS.get(kind)), lambda m: valid(kind, m["value"]))

    return {k: of(k) for k in KINDS}


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column for each kind and ``candidates``, under names that
    cannot clash (prefix ``pii_``)."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({f"pii_{k}": c for k, c in base_spans(body).items()})
    found = F.when(body.rlike("[0-9]"), matches(body, CANDIDATE)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,value:string,before:string>>)"))
    return out.withColumn("pii_candidates", found)


def shape(value: Column) -> Column:
    return (
        F.when(value.rlike("^[0-9]+$"), "digits").when(value.rlike("^[0-9a-fA-F]+$"), "hex").when(value.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("joined")
    )


def pattern(match: Column) -> Column:
    """Hash of a match's context and shape; null without a context."""
    context = F.regexp_extract(match["before"], CONTEXT, 1)
    words = F.lower(F.regexp_replace(F.regexp_replace(context, "[0-9]+", "0"), r"\s+", " "))
    return F.when(context != "", F.xxhash64(words, shape(match["value"])))


def bootstrap(found: DataFrame, *, rounds: int = 8, settled: float = 0.01, accept: float = 0.6, support: float = 3.0) -> DataFrame:
    """``pattern, confidence`` of the patterns that are good enough, from a
    scanned table: instances are distinct values, seeds have belief 1. Rare
    patterns pass belief on too; ``support`` is asked at the end. Rounds go on
    until no belief moves by more than ``settled``, or ``rounds`` are done."""
    seeds = F.concat(*[F.transform(f"pii_{k}", lambda m: F.struct(m["value"].alias("value"), pattern(m).alias("pattern"), F.lit(True).alias("seed"))) for k in KINDS])
    others = F.transform("pii_candidates", lambda m: F.struct(m["value"].alias("value"), pattern(m).alias("pattern"), m["value"].rlike(SECRET).alias("seed")))
    edges = (
        found.select(F.explode(F.concat(seeds, others)).alias("e"))
        .where("e.pattern is not null")
        .groupBy(F.xxhash64("e.value").alias("instance"), F.col("e.pattern").alias("pattern"))
        .agg(F.max("e.seed").alias("seed"))
    )
    edges = written(edges, "graph")
    beliefs = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("belief"))
    for step in range(rounds):
        known = F.round(F.sum("belief"), 9)
        scored = edges.join(beliefs, "instance").groupBy("pattern").agg(known.alias("known"), F.count("*").alias("n"))
        weight = F.log2(1 + F.col("known"))
        scored = scored.select("pattern", "known", (F.col("known") / F.col("n") * weight / (weight + 1)).alias("confidence"))
        if step == rounds - 1:
            break
        doubt = F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999))))
        passed = edges.join(scored, "pattern").groupBy("instance").agg(F.greatest(F.max(F.col("seed").cast("double")), F.round(1 - F.exp(doubt), 9)).alias("next"))
        moved = written(passed.join(beliefs, "instance"), "beliefs")
        if (moved.agg(F.max(F.abs(F.col("next") - F.col("belief")))).first()[0] or 0.0) <= settled:
            break
        if step:
            drop_written(old)
        old, beliefs = moved, moved.select("instance", F.col("next").alias("belief"))
    return scored.where((F.col("confidence") >= accept) & (F.col("known") >= support)).select("pattern", "confidence")


def with_extra(found: DataFrame, patterns: DataFrame, *, at_once: int = 20_000) -> DataFrame:
    """A scanned table with ``pii_extra``: secrets, and candidates behind
    accepted patterns, that no base span overlaps.

    Up to ``at_once`` patterns are compared as a set of constants; more are
    joined, row by row, through a written copy of the table.
    """
    free = F.filter("pii_candidates", lambda m: ~_overlapped(m))
    found = found.withColumn("pii_candidates", free)
    few = patterns.select("pattern").limit(at_once + 1).collect()
    if len(few) <= at_once:
        known = sorted(r[0] for r in few)
        behind = (lambda m: pattern(m).isin(known)) if known else (lambda m: F.lit(False))
        return found.withColumn("pii_extra", F.filter("pii_candidates", lambda m: m["value"].rlike(SECRET) | F.coalesce(behind(m), F.lit(False))))
    rows = written(found.withColumn("pii_row", F.monotonically_increasing_id()), "scanned")
    each = rows.select("pii_row", F.explode("pii_candidates").alias("m")).withColumn("pattern", pattern(F.col("m")))
    extra = each.join(patterns.select("pattern", F.lit(True).alias("good")), "pattern", "left").where(F.col("good") | F.col("m.value").rlike(SECRET)).groupBy("pii_row").agg(F.array_sort(F.collect_list("m")).alias("pii_extra"))
    return rows.join(extra, "pii_row", "left").withColumn("pii_extra", F.coalesce("pii_extra", F.filter("pii_candidates", lambda m: F.lit(False)))).drop("pii_row")


def _overlapped(m: Column) -> Column:
    hit = F.lit(False)
    for k in KINDS:
        hit = hit | F.exists(f"pii_{k}", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    return hit


def listing(*kinds: str) -> Column:
    """``kind:start:end`` of the spans of these kinds, comma-joined."""

    def of(kind: str) -> Column:
        return F.transform(f"pii_{'extra' if kind == 'id' else kind}", lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))

    return F.concat_ws(",", F.concat(*[of(k) for k in kinds]))


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: ``key``, arrays ``pii_email, pii_ip, pii_card, pii_phone, pii_extra``
    of (start, end, value, before)."""
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    found = written(scanned(rows).drop("text"), "scanned")
    return with_extra(found, bootstrap(found, **options)).drop("pii_candidates")


def mask(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with every span of ``text`` exchanged for its kind
    in angle brackets; overlapping spans give one mark for each that reaches on."""
    found = written(scanned(docs, text), "scanned")
    found = with_extra(found, bootstrap(found, **options))

    def of(column: str, kind: str) -> Column:
        return F.transform(f"pii_{column}", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    spans = F.array_sort(F.concat(*[of(k, k) for k in KINDS], of("extra", "id")))
    body = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(s, m):
        gap = F.substr(body, s["at"] + 1, F.greatest(m["start"] - s["at"], F.lit(0)))
        more = F.concat(s["parts"], F.array(gap, F.concat(F.lit("<"), F.upper(m["kind"]), F.lit(">"))))
        return F.when(m["end"] > s["at"], F.struct(m["end"].alias("at"), more.alias("parts"))).otherwise(s)

    done = F.aggregate("pii_spans", start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(body, s["at"] + 1)))
    masked = F.when(F.size("pii_spans") > 0, done).otherwise(body)
    return found.withColumn("pii_spans", spans).withColumn(text, masked).select(*docs.columns)
