"""Archives: round trips through files cut in splits of any size, and payloads that hold records."""

from __future__ import annotations

import base64
import glob
import hashlib
import os
import random
from collections import Counter

import pytest

from barlattice.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, top long, size long, record string"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: %d\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, "r") for r in rows], SCHEMA)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, least=0):
    left, out = {}, Counter()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True):
        size, d = len((html or "").encode()), digest(html)
        revisit = size >= least and d in left
        out[(page, size, d, "revisit" if revisit else "response", left[d] if revisit else None)] += 1
        left.setdefault(d, page)
    return out


def round_trip(spark, rows, split=None, files=3, **kw):
    path = warc.write(pages(spark, rows).repartition(files), **kw)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        got = warc.read(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    number = lambda x: None if x in (None, "urn:page:null") else int(x.removeprefix("urn:page:"))
    assert all(r.sound for r in got)
    return got, Counter((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in got)


def odd_rows():
    rng = random.Random(2)
    rows = [(i, f"https://e.org/{i}", f"<p>{rng.random()}</p>" * rng.randrange(1, 9)) for i in range(40)]
    rows += [(100 + i, None, "same é text") for i in range(5)] + [(200 + i, f"u{i}", None) for i in range(3)] + [(300, "x\r\ny", "")]
    rows += [(400, "a", "tie"), (400, "b", "tie"), (400, "b", "tie"), (399, "b", "tie"), (None, None, "none"), (None, "n", "none"), (None, "n", "low"), (5, "n", "low")]
    inner = "x" * 30
    rows.append((500, "f", "before " + FAKE % 30 + inner + "\r\n\r\n" + FAKE % 4 + "yyyy\r\n\r\nafter"))
    rows.append((501, "f", "WARC/1.1\r\n" * 60 + FAKE % 10_000_000))
    rows.append((502, "f", FAKE % 0 + "\r\n\r\n" + FAKE % 0))
    rows.append((503, "long", "long text " * 40_000 + FAKE % 7 + "z" * 300))
    return rows


@pytest.mark.parametrize("split", [None, 900])
def test_only_real_records_are_read(spark, split):
    rows = odd_rows()[:-1] if split else odd_rows()
    got, kinds = round_trip(spark, rows, split)
    assert kinds == expected(rows)
    want = {(page, html or "") for page, _, html in rows}
    assert all((r.record_id, r.payload.decode()) in {(f"urn:page:{'null' if p is None else p}", h) for p, h in want} for r in got if r.record_type == "response")
    urls = {r.record_id: r.url for r in got}
    assert urls["urn:page:300"] == "xy" and urls["urn:page:7"] == "https://e.org/7" and urls["urn:page:101"] is None


def test_small_payloads_may_all_be_responses(spark):
    rows = odd_rows()[:-4]
    assert round_trip(spark, rows, least_bytes=5)[1] == expected(rows, 5)


def test_no_pages(spark):
    assert round_trip(spark, [])[0] == []


def test_a_fake_whose_record_ends_on_a_real_one_is_no_record(spark):
    tail = "y" * 50
    rows = [(1, "a", "x" * 20 + FAKE % len(tail) + tail), (2, "b", "plain")]
    got, kinds = round_trip(spark, rows, files=1)
    assert kinds == expected(rows) and len(got) == 2


def test_what_follows_a_break_is_not_read(spark, tmp_path):
    path = warc.write(pages(spark, [(i, "u", f"text {i}") for i in range(6)]).coalesce(1))
    (file,) = glob.glob(path.removeprefix("file:").replace("//", "/") + "/part-*")
    whole = open(file, "rb").read()
    starts = [i for i in range(len(whole)) if whole.startswith(b"WARC/1.1", i)]
    broken = whole[: starts[3]] + b"garbage" + whole[starts[3] :]
    folder = tmp_path / "broken"
    os.mkdir(folder)
    (folder / "a.warc").write_bytes(broken)
    for size in ("128m", "150"):
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert len(warc.read(spark, f"file://{folder}").collect()) == 3
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pieces_in_order_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "small", lambda df: df)
    rows = odd_rows()[40:-1]
    assert round_trip(spark, rows, 900)[1] == expected(rows)
