"""WARC archives: round trips, revisits, and archives with missing or damaged records."""

import base64
import gzip
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from pipelytics.llm import warc
from pipelytics.session import scratch_path

ODD = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\nWARC/1.1\r\n after"


def round_trip(spark, pages, **options):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(warc.typed(warc.stage(pages)), path, **options)
    return path, warc.reassemble(warc.read_records(spark, path))


def expected(rows):
    """Page id: bytes, digest, type, refers_to. Keys must differ."""
    best = {}
    for key, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), key)
    out = {}
    for key, _, html in rows:
        data = (html or "").encode()
        top = best[html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[key] = (len(data), digest, "response" if top == key else "revisit", None if top == key else str(top))
    return out


ROWS = [
    (0, "http://a/0", "ä" * 5000), (1, "http://a/1", None), (2, "http://a/2", ""), (3, None, ODD), (4, "http://a/4\r\nX: y", ODD),
    (5, "http://b/5", "x" * 1_000_000), (6, "http://b/6", "\r\n\r\n"), (7, "http://b/7", "plain"), (8, "http://b/8", "ä" * 5000),
]


@pytest.mark.parametrize("segment, chunk", [(32_768, 4096), (97, 7)])
def test_round_trip(spark, segment, chunk):
    rows = ROWS if segment > 100 else [r for r in ROWS if r[0] != 5]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    pages = pages.withColumn("payload", F.lit(1)).repartition(3)
    path, read = round_trip(spark, pages, segment_bytes=segment, chunk_bytes=chunk, records_per_file=2)
    got = {
        int(r.key): (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
        for r in warc.resolve(read).collect()
        if r.status == "complete"
    }
    assert got == expected(rows)
    texts = {int(r.key): r.payload for r in read.where("type = 'response'").collect()}
    assert all(bytes(texts[k]).decode() == (h or "") for k, _, h in rows if k in texts)
    assert read.where("segments > 1").count() > 0


def test_equal_rows_and_keys(spark):
    rows = [(1, "u", "same")] * 3 + [(None, "u", "same"), (2, "u", "same"), (2, "v", "same"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.resolve(round_trip(spark, pages)[1]).collect()
    kinds = sorted((r.key or "", r.record_type, r.refers_to or "") for r in got)
    assert kinds == sorted([("1", "revisit", "2")] * 3 + [("", "revisit", "2"), ("2", "revisit", "2"), ("2", "response", "")] + [("", "response", "")])
    assert {r.status for r in got} == {"complete"}


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.key: r.refers_to is None for r in warc.typed(warc.stage(pages), least_bytes=3).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path, read = round_trip(spark, pages)
    assert warc.resolve(read).count() == 0


def archive(tmp_path, records, name="a.warc.gz"):
    (tmp_path / name).write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in records)))
    return str(tmp_path)


def long_record(text="0123456789" * 50, segment=120):
    name = str(uuid.uuid4())
    return list(warc.records_of(name, "7", "u", warc_digest(text), None, text.encode(), "2000-01-01T00:00:00Z", segment, 64))


def warc_digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def states(spark, path):
    return [(r.key, r.status) for r in warc.resolve(warc.reassemble(warc.read_records(spark, path))).collect()]


def test_records_in_any_order_and_file(spark, tmp_path):
    parts = long_record()
    archive(tmp_path, parts[::2][::-1], "a.warc.gz")
    archive(tmp_path, [*parts[1::2], parts[1]], "b.warc.gz")  # one of them twice
    assert states(spark, str(tmp_path)) == [("7", "complete")]


@pytest.mark.parametrize(
    "harm, state",
    [
        (lambda p: p[:2] + p[3:], "segment is missing"),
        (lambda p: p[:-1], "last segment is missing"),
        (lambda p: [*p, p[1].replace(b"0", b"1", 1)], "complete"),
        (lambda p: [*p[:2], p[2].replace(b"12345", b"1234x"), *p[3:]], "other digest than declared"),
        (lambda p: [p[0], *p[1:-1], p[-1].replace(b"Total-Length: 6", b"Total-Length: 7")], "other total length than declared"),
    ],
)
def test_damage(spark, tmp_path, harm, state):
    got = states(spark, archive(tmp_path, harm(long_record())))
    assert ("7", state) in got or state == "complete" and got[0][1] in ("segments contradict each other", "complete")


def test_cut_file_and_bad_chunks(spark, tmp_path):
    good = long_record(segment=10_000)[0]
    bad = good.replace(b"\r\n40\r\n", b"\r\nzz\r\n", 1)
    cut = good[:-100]
    path = archive(tmp_path, [good, bad, b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length", cut])
    assert sorted(s for _, s in states(spark, path)) == ["broken chunks", "complete", "record cut short", "record cut short"]


def test_orphans(spark, tmp_path):
    path = archive(tmp_path, long_record()[1:])
    [(key, state)] = states(spark, path)
    assert key is None and state == "segment is missing"
    revisit = list(warc.records_of(str(uuid.uuid4()), "9", "u", warc_digest("q"), str(uuid.uuid4()), b"", "2000", 10_000, 64))
    archive(tmp_path, revisit, "r.warc.gz")
    assert ("9", "response is missing") in states(spark, str(tmp_path))


def test_framing():
    for data in (b"", b"a", b"abc" * 1000):
        assert warc.dechunked(warc.chunked(data, 7)) == data
    for broken in (b"", b"5\r\nab", b"-1\r\n", b"g\r\n", b"2\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)
