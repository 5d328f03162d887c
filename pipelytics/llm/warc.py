"""WARC archives: written with segments and revisits, read back, and put together again.

Writing: ``stage`` fixes a record id, the payload and its digest for each page,
``typed`` makes one record of equal payloads the response and the others its
revisits, and ``write_archives`` frames payloads in HTTP chunks and cuts long
blocks into a first record and ``continuation`` records. Reading:
``read_records`` gives a row per record, ``reassemble`` groups continuation
records by the id of their origin, orders them by segment number, checks the
numbers and the total length and undoes the chunked framing, and ``resolve``
gives revisits the payload's figures of the record that they refer to.

Archives are written as gzip files of a bounded number of records. Spark's text
reader streams such a file record by record, the version line being the
separator, so no task holds more than one record and one batch. A payload that
holds the separator itself is put together again by its declared length.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x1F\x7F]")
_GAP = b"\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: five hexadecimal digits become four of base 32, and then letters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def stage(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``record_id, key, url, payload, payload_bytes, payload_digest`` per page, written to the shared folder.

    Record ids are random, so they are fixed here: a task that is run again later
    sees the same ones. Rows that are equal in all columns get records of their
    own. A null text is an empty payload; other columns of ``pages`` are left out.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.expr("uuid()").alias("record_id"), F.col(key).alias("key"), F.col(url).cast("string").alias("url"),
        payload.alias("payload"), F.length(payload).cast("bigint").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )
    return materialise(rows, "payloads")


def typed(staged: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``refers_to``: null for responses, for revisits the record id of their response.

    Of equal payloads (same digest and length) of at least ``least_bytes`` the
    record with the largest key is the response; a null key is the smallest, and
    records with the same key are told apart by their ids. Only payloads that
    occur twice or more enter the join, so the table of responses is small where
    few pages repeat.
    """
    same = ["payload_digest", "payload_bytes"]
    repeated = (
        staged.where(F.col("payload_bytes") >= least_bytes)
        .groupBy(*same)
        .agg(F.max(F.struct("key", "record_id")).alias("top"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(*same, F.col("top.record_id").alias("origin"))
    )
    joined = staged.join(materialise(repeated, "responses"), same, "left")
    return joined.withColumn("refers_to", F.when(F.col("origin") != F.col("record_id"), F.col("origin"))).drop("origin")


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in HTTP's chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Undo the chunked framing; raises ``ValueError`` where the framing is broken or ends early."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:end].split(b";")[0].strip() or b"?", 16)
        if size < 0:
            raise ValueError("chunk of negative size")
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        parts.append(body[at : at + size])
        at += size + 2


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    lines = [f"{k}: {_UNSAFE.sub(lambda m: f'%{ord(m.group()):02X}', v)}" for k, v in fields if v is not None]
    return "\r\n".join([VERSION, *lines, "", ""]).encode()


def records_of(
    record_id: str, key: str | None, url: str | None, digest: str, refers_to: str | None, payload: bytes,
    date: str, segment_bytes: int, chunk_bytes: int,
) -> Iterator[bytes]:
    """The records of one page without their closing blank lines: a revisit, a response, or a response and continuations."""
    block = _HTTP if refers_to else _HTTP + chunked(payload, chunk_bytes)
    segments = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    for number, segment in enumerate(segments, 1):
        name = record_id if number == 1 else str(uuid.uuid5(uuid.UUID(record_id), str(number)))
        fields = [
            ("WARC-Type", "continuation" if number > 1 else "revisit" if refers_to else "response"),
            ("WARC-Record-ID", f"<urn:uuid:{name}>"),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
        ]
        if number == 1:
            fields += [
                ("WARC-Payload-Digest", f"sha1:{digest}"),
                ("WARC-Profile", _PROFILE if refers_to else None),
                ("WARC-Refers-To", f"<urn:uuid:{refers_to}>" if refers_to else None),
                ("Content-Type", "application/http; msgtype=response"),
                ("X-Source-Key", key),
            ]
        else:
            fields.append(("WARC-Segment-Origin-ID", f"<urn:uuid:{record_id}>"))
        if len(segments) > 1:
            fields.append(("WARC-Segment-Number", str(number)))
            if number == len(segments):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        fields.append(("Content-Length", str(len(segment))))
        yield _header(fields) + segment


def write_archives(
    typed: DataFrame, path: str, segment_bytes: int = 32_768, chunk_bytes: int = 4_096,
    records_per_file: int = 10_000, date: str = "2000-01-01T00:00:00Z",
) -> None:
    """Write the records as ``.gz`` archives below ``path``; a file holds at most ``records_per_file`` records.

    Every record ends in two line ends, which is what Spark's text writer puts after each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for k in range(batch.num_rows):
                for record in records_of(*[c[k].as_py() for c in columns], date, segment_bytes, chunk_bytes):
                    held.append(record)
                    size += len(record)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    rows = typed.select(
        "record_id", F.col("key").cast("string"), "url", "payload_digest", "refers_to",
        F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
    )
    records = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    writer = records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


_RECORD = (
    "record_id string, type string, key string, url string, digest string, refers_to string, origin_id string,"
    " segment int, total_length bigint, block binary"
)
_FIELDS = {
    b"warc-record-id": 0, b"warc-type": 1, b"x-source-key": 2, b"warc-target-uri": 3, b"warc-payload-digest": 4,
    b"warc-refers-to": 5, b"warc-segment-origin-id": 6, b"warc-segment-number": 7, b"warc-segment-total-length": 8,
}
_URN = re.compile(r"^<(?:urn:uuid:)?(.*)>$")


def _whole_number(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() and len(value) < 19 else None


class RecordParser:
    """Cuts what stands between version lines into records, and joins what a payload's own version line has cut."""

    def __init__(self):
        self.pieces: list[bytes] = []
        self.have = self.begin = self.need = 0
        self.values: list = []

    def feed(self, piece: bytes) -> tuple | None:
        """The record that ``piece`` completes, if it completes one; one without a length has a null block."""
        if self.pieces:
            more = VERSION.encode() + b"\r\n" + piece
            self.pieces.append(more)
            self.have += len(more)
        elif not piece:
            return None
        else:
            self.pieces, self.have = [piece], len(piece)
            self.values, self.begin, length = self._header(piece)
            if length is None:
                return self.rest()
            self.need = self.begin + length
        return self.rest() if self.have >= self.need else None

    def rest(self) -> tuple | None:
        """The record that is held, with a null block if it is not whole."""
        if not self.pieces:
            return None
        whole = self.have >= self.need > 0
        block = b"".join(self.pieces)[self.begin : self.need] if whole else None
        self.pieces, self.need = [], 0
        return (*self.values, block)

    @staticmethod
    def _header(data: bytes) -> tuple[list, int, int | None]:
        end = data.find(_GAP)
        values, length = [None] * 9, None
        for line in data[: max(end, 0)].split(b"\r\n"):
            name, _, value = line.partition(b":")
            name, text = name.strip().lower(), value.strip().decode("utf-8", "replace")
            if name == b"content-length":
                length = _whole_number(text)
            elif name in _FIELDS:
                values[_FIELDS[name]] = text
        for k in (0, 5, 6):
            values[k] = _URN.sub(r"\1", values[k]) if values[k] else None
        values[4] = values[4].removeprefix("sha1:") if values[4] else None
        values[7:] = [_whole_number(v) for v in values[7:]]
        return values, end + len(_GAP), length


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the ``.gz`` archives below ``path``.

    Spark does not split gzip files, so a task meets the pieces of a file in
    order. A record that its file ends too early for has a null ``block``.
    """
    types = [
        pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(),
        pa.binary(),
    ]
    names = [c.split()[0] for c in _RECORD.split(",")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, file, held, size = RecordParser(), None, [], 0
        for batch in batches:
            pieces, files = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                here, piece = files[k].as_py(), pieces[k].as_py()
                made = []
                if here != file:
                    made.append(parser.rest())
                    file = here
                made.append(parser.feed(piece))
                for record in made:
                    if record:
                        held.append(record)
                        size += len(record[-1] or b"")
                if size > 4_000_000:
                    yield packed(held)
                    held, size = [], 0
        last = parser.rest()
        held += [last] if last else []
        if held:
            yield packed(held)

    lines = spark.read.option("lineSep", f"{VERSION}\r\n").option("pathGlobFilter", "*.gz").text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file")).mapInArrow(
        run, _RECORD
    )


def payload_of(block: bytes | None) -> tuple[bytes | None, str]:
    """The payload of an HTTP response block, and ``complete`` or what is wrong with it."""
    if block is None:
        return None, "record cut short"
    head, gap, body = block.partition(_GAP)
    if not gap:
        return None, "no HTTP header"
    lines = [x.partition(b":") for x in head.lower().split(b"\r\n")[1:]]
    fields = {k.strip(): v.strip() for k, _, v in lines}
    if fields.get(b"transfer-encoding") == b"chunked":
        try:
            return dechunked(body), "complete"
        except ValueError:
            return None, "broken chunks"
    length = fields.get(b"content-length")
    if length is not None and length != b"%d" % len(body):
        return None, "other length than declared"
    return body, "complete"


def joined_block(segments: list[dict], total: int | None) -> tuple[bytes | None, str]:
    """The block of a segmented record; ``segments`` are distinct pairs of number and block, in order."""
    numbers = [s["segment"] for s in segments]
    if len(set(numbers)) < len(numbers):
        return None, "segments contradict each other"
    if total is None:
        return None, "last segment is missing"
    if numbers != list(range(1, len(numbers) + 1)):
        return None, "segment is missing"
    if any(s["block"] is None for s in segments):
        return None, "record cut short"
    block = b"".join(s["block"] for s in segments)
    if len(block) != total:
        return None, "other total length than declared"
    return block, "complete"


def reassemble(records: DataFrame) -> DataFrame:
    """``record_id, type, key, url, digest, refers_to, payload, status, segments`` per response or revisit.

    Only records with a segment number are shuffled, by the id of their origin;
    a group is the records of one page. Repeated equal segments count once.
    Where a payload cannot be put together it is null and ``status`` says why;
    a revisit has no payload of its own. Continuations whose first record is
    missing give a row of type null.
    """
    own = ["type", "key", "url", "digest", "refers_to"]
    single = records.where(F.col("segment").isNull() & F.coalesce(F.col("type").isin("response", "revisit"), F.lit(False)))
    whole = single.select(
        "record_id", *own, F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("parts"),
        F.length("block").cast("bigint").alias("total"), F.lit(1).alias("segments"),
    )
    first = F.when(F.col("type") != "continuation", F.struct(*own))
    grouped = (
        records.where(F.col("segment").isNotNull())
        .groupBy(F.coalesce("origin_id", "record_id").alias("record_id"))
        .agg(
            F.max(first).alias("first"), F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
            F.max("total_length").alias("total"),
        )
        .select("record_id", *[f"first.{c}" for c in own], "parts", "total", F.size("parts").alias("segments"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(k) for k in range(6)]
            kinds, parts, totals = (batch.column(k) for k in (1, 6, 7))
            payloads, states = [], []
            for k in range(batch.num_rows):
                pieces = parts[k].as_py()
                if len(pieces) == 1 and pieces[0]["block"] is None:
                    block, state = None, "record cut short"
                else:
                    block, state = joined_block(pieces, totals[k].as_py())
                payload = None
                if state == "complete" and kinds[k].as_py() == "response":
                    payload, state = payload_of(block)
                payloads.append(payload)
                states.append(state)
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(payloads, pa.binary()), pa.array(states, pa.string()), batch.column(8)],
                names=["record_id", *own, "payload", "status", "segments"],
            )

    schema = "record_id string, " + ", ".join(f"{c} string" for c in own) + ", payload binary, status string, segments int"
    return whole.unionByName(grouped).mapInArrow(run, schema)


def resolve(pages: DataFrame) -> DataFrame:
    """``key, url, record_type, refers_to, payload_bytes, payload_digest, status, segments`` per response and revisit.

    Figures are those of the payload as it was read, for a revisit those of the
    response that it refers to, whose key is ``refers_to``. A payload whose digest is
    not the declared one says so in ``status``; so does a revisit of no known response.
    """
    payload = F.col("payload")
    read = materialise(
        pages.select(
            "record_id", "key", "url", F.col("type").alias("record_type"), F.col("refers_to").alias("origin"),
            F.col("digest").alias("declared"), F.length(payload).cast("bigint").alias("payload_bytes"),
            base32_sha1(payload).alias("payload_digest"), "status", "segments",
        ),
        "payload-figures",
    )
    whole = F.col("status") == "complete"
    wrong = whole & (F.col("payload_digest") != F.col("declared"))
    checked = read.withColumn("status", F.when(wrong, "other digest than declared").otherwise(F.col("status")))
    columns = ["key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "status", "segments"]
    plain = checked.where(~F.coalesce(F.col("record_type") == "revisit", F.lit(False)))
    plain = plain.withColumn("refers_to", F.lit(None).cast("string"))
    sources = plain.where(F.col("record_type") == "response").select(
        F.col("record_id").alias("origin"), F.col("key").alias("refers_to"), "payload_bytes", "payload_digest",
        F.col("status").alias("_found"),
    )
    revisits = checked.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    revisits = revisits.join(sources, "origin", "left").withColumn(
        "status",
        F.when(F.col("status") != "complete", F.col("status"))
        .when(F.col("_found").isNull(), "response is missing")
        .when(F.col("payload_digest") != F.col("declared"), "other digest than declared")
        .otherwise(F.col("_found")),
    )
    return plain.select(*columns).unionByName(revisits.select(*columns))
