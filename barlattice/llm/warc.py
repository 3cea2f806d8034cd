"""WARC archives of pages, written and read back by Spark.

Writing: a page is an HTTP response record. Of pages with equal payloads the one of
the largest page id keeps the payload, the others are revisit records that refer to
it. Files are those of Spark's text writer, whose line separator is the end of a
WARC record, so any store, retries and lost executors are Spark's matter.

Reading: a file is cut at every ``WARC/1.1`` line into pieces, in splits that tasks
read at once; such a line may also stand in a payload. Each task parses its pieces
as candidate records and emits where a candidate would end, its successor. Inside a
split candidates are chained from the back, so that only the first candidate reached
in a split is left open; those borders are resolved by pointer jumping from the start
of each file. Candidates that the chain doesn't reach lie inside payloads. A second
reading puts the pieces of each reached record together, across splits where need be.

Null and empty payloads are payloads of no bytes. Pages of the same id and payload
are one response and revisits to that id, interchangeable where all else is equal;
null ids are less than all others. Very long payloads are held one at a time. An empty
table writes no record. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, shared_dir, slices, small, written

MAGIC, RECORD_END = "WARC/1.1\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"

#: Digits of base 32, for conv() and in digests (fixed values).
CONV32, DIGEST32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    fives = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*fives), CONV32, DIGEST32)


def _key(page: Column) -> Column:
    return F.coalesce(page.cast("string"), F.lit("null"))


def _record(kind: str, extra: list[Column], block: Column) -> Column:
    """One record without the separator that ends it."""
    url = F.translate(F.col("url"), "\r\n", "")
    lines = [
        F.lit(f"{MAGIC}WARC-Type: {kind}\r\nWARC-Record-ID: <{URN}"), _key(F.col("page_id")), F.lit(">\r\nWARC-Date: "), F.col("warc_date"),
        F.when(url.isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), url)).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), *extra,
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    ]
    return F.concat(*lines)


def write(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write a WARC record for each row of ``pages(page_id, url, html)``; the folder
    of the files, by default a new one in the folder that the cluster shares. Equal
    payloads of fewer bytes than ``least_bytes`` all stay responses. Line ends in
    urls are left out."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("html"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"), F.lit(date).alias("warc_date"))
    # Which payloads occur more than once, the largest page id of each, and how often that one has it.
    by_page = own.where(F.col("bytes") >= least_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    repeated = by_page.groupBy("digest").agg(F.max("page_id").alias("top"), F.sum("n").alias("copies"), F.max(F.struct("page_id", "n"))["n"].alias("top_copies")).where("copies > 1").drop("copies")
    repeated = written(repeated, "repeated")
    typed = own.join(small(repeated), "digest", "left")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    response = _record("response", [], F.concat(head, F.col("html"))).alias("record")
    refers = [F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{URN}"), _key(F.col("top")), F.lit(">")]
    revisit = _record("revisit", refers, head).alias("record")
    is_top = F.col("page_id").eqNullSafe(F.col("top"))
    several = F.coalesce(F.col("top_copies") > 1, F.lit(False)) & is_top
    plain = typed.where(~several).select(F.when(F.col("top_copies").isNull() | is_top, response).otherwise(revisit).alias("record"))
    # Rows of one id and payload: one response for them all, revisits for the rest.
    tied = typed.where(several)
    first = tied.groupBy("digest").agg(F.max("url").alias("url"), *(F.any_value(c).alias(c) for c in ("page_id", "html", "bytes", "warc_date")))
    urls = tied.groupBy("digest", "url").agg(F.count("*").alias("n"), *(F.any_value(c).alias(c) for c in ("page_id", "top", "bytes", "warc_date")))
    highest = first.select("digest", F.col("url").alias("first_url"))
    rest = urls.join(highest, "digest").withColumn("n", F.col("n") - F.col("url").eqNullSafe(F.col("first_url")).cast("int")).where("n > 0")
    again = rest.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(revisit)
    out = plain if repeated.where("top_copies > 1").isEmpty() else plain.unionByName(first.select(response)).unionByName(again)
    out.write.option("lineSep", RECORD_END).text(path)
    drop_written(repeated)
    return path


def header(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of a record's header and where its block begins, if ``piece``, what
    follows a magic line, has a whole one with a type and a length."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if "warc-type" not in fields or not fields.get("content-length", "").isascii() or not fields.get("content-length", "").isdigit():
        return None
    return fields, end + 4


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic lines, in the order of each split of each file."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))


CANDIDATES = "file string, split long, at long, size long, bytes long"


def _candidates(pieces: DataFrame) -> DataFrame:
    """Candidates by their place in their split and the size of their record (end
    included); at the end of a split a row without place has the split's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 5, kinds)], names=["file", "split", "at", "size", "bytes"])

        here, at = None, 0
        for batch in slices(batches, 2):
            found = []
            for file, split, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if here != (file, split):
                    if here:
                        found.append((*here, None, None, at))
                    here, at = (file, split), 0
                if (split or at) and (parsed := header(piece)):
                    # The magic before a piece belongs to the piece before it, hence the place.
                    found.append((file, split, at - len(MAGIC), len(MAGIC) + parsed[1] + int(parsed[0]["content-length"]) + len(RECORD_END), None))
                at += len(piece) + len(MAGIC)
            yield rows(found)
        if here:
            yield rows([(*here, None, None, at)])

    return pieces.mapInArrow(run, CANDIDATES)


CHAINED = "file string, split long, at long, onward long, last long, ends long"


def _chained(candidates: DataFrame) -> DataFrame:
    """``at`` to ``onward``, the first place of its chain that lies in a later split
    (null: the chain breaks), and ``last``, the last in this one, with its end."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("at", "next"))))
        until = table.column("until")[0].as_py()
        onward: dict[int, tuple[int | None, int, int]] = {}
        for at, nxt in reversed(rows):
            onward[at] = (nxt, at, nxt) if nxt >= until else onward.get(nxt, (None, at, nxt))
        n = len(rows)
        return pa.table({
            "file": pa.array([table.column("file")[0].as_py()] * n, pa.string()), "split": pa.array([table.column("split")[0].as_py()] * n, pa.int64()), "at": pa.array([at for at, _ in rows], pa.int64()),
            "onward": pa.array([onward[at][0] for at, _ in rows], pa.int64()), "last": pa.array([onward[at][1] for at, _ in rows], pa.int64()),
            "ends": pa.array([onward[at][2] for at, _ in rows], pa.int64()),
        })

    return candidates.groupBy("file", "split").applyInArrow(run, CHAINED)


def _reached(chained: DataFrame) -> DataFrame:
    """The rows of ``chained`` that are reached from the starts of their files: in
    each round the reached ones also take what lies twice as far."""
    targets = chained.where("onward is not null").select("file", F.col("onward").alias("at")).distinct()
    starts = chained.where("at = 0").select("file", "at")
    borders = targets.union(starts).distinct()
    jump = written(chained.select("file", "at", "onward").join(borders, ["file", "at"]), "jump")
    reached = written(starts, "reached")
    count = reached.count()
    while True:
        further = reached.join(jump, ["file", "at"]).where("onward is not null").select("file", F.col("onward").alias("at"))
        after = written(reached.union(further).distinct(), "reached")
        now = after.count()
        drop_written(reached)
        reached = after
        if now == count:
            break
        twice = jump.select("file", F.col("at").alias("onward"), F.col("onward").alias("beyond"))
        farther = written(jump.join(twice, ["file", "onward"], "left").select("file", "at", F.col("beyond").alias("onward")), "jump")
        drop_written(jump)
        jump, count = farther, now
    drop_written(jump)
    return chained.join(reached, ["file", "at"])


RECORD = "record_type string, record_id string, url string, payload_digest string, refers_to string, payload_bytes long, sound boolean, payload binary"
PART = "file string, record long, part long, body binary"


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def parsed(body: bytes, payload: bool) -> tuple:
    """A row of RECORD from a record's bytes."""
    fields, begins = header(body[len(MAGIC) :])
    begins += len(MAGIC)
    top, _, content = body[begins : begins + int(fields["content-length"])].partition(b"\r\n\r\n")
    http = dict(line.decode("latin-1").lower().split(": ", 1) for line in top.split(b"\r\n")[1:] if b": " in line)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    length, revisit = int(http.get("content-length", len(content))), fields["warc-type"] == "revisit"
    sound = revisit or (length == len(content) and base64.b32encode(hashlib.sha1(content).digest()).decode() == digest)
    names = [fields.get(f, "").strip("<>") or None for f in ("warc-record-id", "warc-target-uri", "warc-refers-to")]
    return (fields["warc-type"], *names[:2], digest, names[2], length, sound, content if payload and not revisit else None)


def _assembled(pieces: DataFrame, payload: bool, torn: bool) -> DataFrame:
    """Reached records that their split holds whole, as RECORD; with ``torn`` the
    parts of the others, as PART. Pieces have the start of their split, its first
    reached record, and the one before that with its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = record = due = None
        at = first = ends = 0
        held: list[bytes] = []

        def flushed() -> list[tuple]:
            body = b"".join(held)
            held.clear()
            whole = first == record and len(body) >= ends - record
            return [] if not body or whole == torn else [(here[0], record, first, body)] if torn else [parsed(body, payload)]

        for batch in slices(batches, 2):
            out = []
            for file, split, piece, start, entry, before, before_ends in zip(*(c.to_pylist() for c in batch.columns)):
                if here != (file, split):
                    out += flushed()
                    here, at, record, first, ends, due = (file, split), start, before, start - len(MAGIC), before_ends or 0, entry
                place = at - len(MAGIC)
                at += len(piece) + len(MAGIC)
                if place == due and (own := header(piece)):
                    out += flushed()
                    record = first = place
                    ends = due = place + len(MAGIC) + own[1] + int(own[0]["content-length"]) + len(RECORD_END)
                if record is not None and place < ends:
                    # A piece comes without the magic before it.
                    held += [MAGIC.encode(), piece]
            yield _arrow(out, PART if torn else RECORD)
        yield _arrow(flushed(), PART if torn else RECORD)

    return pieces.select("file", "split", "piece", "start", "entry", "before", "before_ends").mapInArrow(run, PART if torn else RECORD)


def _joined(parts: DataFrame, payload: bool) -> DataFrame:
    """Records from their parts, no more than one record's in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            yield _arrow([parsed(b"".join(p), payload) for p in batch.column(0).to_pylist()], RECORD)

    gathered = parts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("part", "body"))).alias("parts"))
    return gathered.select(F.col("parts.body").alias("bodies")).mapInArrow(run, RECORD)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive: record_type, record_id, url, payload_digest,
    refers_to (null but for revisits), payload_bytes, sound (length and digest are
    those of the payload) and, unless left out, the payload (null for revisits).

    What is sent to all tasks is a row for each split of a file, some 100 bytes for
    128 MB, and only behind a check of its size.
    """
    candidates = written(_candidates(_pieces(spark, path)), "candidates")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = candidates.where("bytes is not null").select("file", "split", "bytes").withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    splits = written(splits.withColumn("until", F.col("start") + F.col("bytes") - len(MAGIC)), "splits")
    placed = candidates.where("at is not null").join(small(splits.drop("bytes")), ["file", "split"])
    at = F.col("start") + F.col("at")
    chained = written(_chained(placed.select("file", "split", at.alias("at"), (at + F.col("size")).alias("next"), "until")), "chained")
    entries = _reached(chained).groupBy("file", "split").agg(F.min("at").alias("entry"), F.max(F.struct("last", "ends")).alias("tail"))
    known = splits.join(entries, ["file", "split"], "left").withColumn("earlier", F.last("tail", ignorenulls=True).over(before))
    known = written(known.select("file", "split", "start", "entry", F.col("earlier.last").alias("before"), F.col("earlier.ends").alias("before_ends")), "entries")
    for df in (candidates, splits, chained):
        drop_written(df)
    pieces, sent = _pieces(spark, path), small(known)
    if sent is known:  # too many splits to send: pieces are shuffled, and put in order again
        pieces = pieces.withColumn("order", F.monotonically_increasing_id()).join(known, ["file", "split"]).sortWithinPartitions("file", "split", "order")
    else:
        pieces = pieces.join(sent, ["file", "split"])
    result = _assembled(pieces, payload, torn=False)
    if not known.where(F.col("before_ends") > F.col("start") - len(MAGIC)).isEmpty():
        result = result.unionByName(_joined(_assembled(pieces, payload, torn=True), payload))
    return result if payload else result.drop("payload")


def page_of(record_id: str | Column) -> Column:
    """The page id in a record's id."""
    return F.nullif(F.substring(F.col(record_id) if isinstance(record_id, str) else record_id, len(URN) + 1, 1 << 30), F.lit("null"))
