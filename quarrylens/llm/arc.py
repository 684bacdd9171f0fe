"""Legacy archives: ARC records become equivalent WARC records, archive files are written and read back."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shared import new_path

END = b"\r\n\r\n"
#: The fields of the header lines that the two versions of the ARC format declare.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}


def arc_header(version: int, fields: dict[str, str]) -> bytes:
    return " ".join(re.sub(r"\s", "%20", fields.get(f, "") or "-") for f in FIELDS[version]).encode() + b"\n"


def arc_version_block(version: int, name: str = "pages.arc", date: str = "19700101000000") -> bytes:
    body = f"{version} 0 quarrylens\n{' '.join({'url': 'URL', 'ip': 'IP-address', 'date': 'Archive-date', 'type': 'Content-type', 'length': 'Archive-length', 'status': 'Result-code', 'checksum': 'Checksum', 'location': 'Location', 'offset': 'Offset', 'filename': 'Filename'}[f] for f in FIELDS[version])}\n".encode()
    return arc_header(version, {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "length": str(len(body)), "status": "200", "filename": name}) + body + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record. The version block says how many fields the lines have; a declared
    length decides where a record ends, whatever bytes it holds. Raises ValueError for a line or length that can't be."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        values = line.split(" ")
        names = FIELDS[1] if line.startswith("filedesc://") and len(values) == 5 else FIELDS[2] if line.startswith("filedesc://") else FIELDS[version]
        if len(values) != len(names) or not values[-1].isdigit() or end < 0:
            raise ValueError(f"no ARC header line of {len(names)} fields at byte {at}: {line[:80]!r}")
        fields = dict(zip(names, values, strict=True))
        body = data[end + 1 : end + 1 + int(fields["length"])]
        if len(body) != int(fields["length"]):
            raise ValueError(f"the record at byte {at} is shorter than its length says")
        if line.startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
        else:
            yield fields, body
        at = end + 1 + len(body)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    """The same for every attempt of a task: a name-based identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def http_payload(content: bytes) -> tuple[bytes, bytes]:
    """The HTTP head of a record's content, with the blank line that ends it, and what follows; no head if there is none."""
    end = content.find(END) + len(END) if content.startswith(b"HTTP/") else 0
    return (content[:end], content[end:]) if end >= len(END) else (b"", content)


def warc_record(fields: dict[str, str], content: bytes, key: str, refers_to: str | None = None) -> bytes:
    """The WARC record, without the blank lines that end it, for an ARC record; key names it.

    Content with an HTTP head is an HTTP response, whose payload is what follows the head; other content is its own
    payload, of the type that the ARC line gives. A revisit keeps the head and leaves the payload out.
    """
    date = fields["date"] if re.fullmatch(r"\d{14}", fields["date"]) else "19700101000000"
    http, payload = http_payload(content)
    digest, body = payload_digest(payload), http if refers_to else content
    head = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(key)), ("WARC-Target-URI", fields["url"]),
        ("WARC-Date", f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:]}Z"), ("WARC-IP-Address", fields["ip"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(body)}"), ("X-Source-Key", key), ("X-Payload-Length", str(len(payload))),
        *([("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Key", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if refers_to else []),
        ("Content-Type", "application/http; msgtype=response" if http else fields["type"]), ("Content-Length", str(len(body))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {re.sub(r'[\r\n]', ' ', v)}\r\n" for k, v in head).encode() + b"\r\n" + body


def parse_warc(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record, by the declared lengths; one record is held at a time."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    while first := stream.readline():
        if first == b"\r\n":  # blank lines between records
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where {first[:40]!r} stands")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            head[key] = value.removeprefix(" ")
        n = int(head["Content-Length"])
        body = stream.read(n)
        if len(body) != n or stream.read(4) != END:
            raise ValueError(f"the record {head.get('WARC-Record-ID')} doesn't end where its length says")
        yield head, body


def _to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page as a legacy archive of one record; both versions of the format occur."""
    for batch in batches:
        out = []
        for key, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            html, version = html or b"", 1 + (key or 0) % 2
            body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html
            head = {"url": url or "about:blank", "ip": "0.0.0.0", "date": "20000101000000", "type": "text/html", "status": "200", "checksum": "-", "offset": "0", "filename": "pages.arc", "length": str(len(body))}
            out.append(arc_version_block(version) + arc_header(version, head) + body + b"\n")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(3)], ["page_id", "arc", "refers_to"])


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, arc, refers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for n, (fields, body) in enumerate(parse_arc(arc)):
                out.append(warc_record(fields, body, f"{key}" if not n else f"{key}/{n}", None if refers is None else str(refers)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


COLUMNS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("content", pa.binary())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), COLUMNS, strict=True)], [n for n, _ in COLUMNS])


class _Pieces(io.RawIOBase):
    """The bytes of files that were cut at END; a file whose last piece is no record's end has blank lines more."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        if self.at >= len(self.held):
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.held, self.at = piece + END, 0
        part = self.held[self.at : self.at + len(into)]
        into[: len(part)] = part
        self.at += len(part)
        return len(part)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of files that come in pieces; a record at a time is held. A payload that isn't what its digest says is an error."""
    rows, size = [], 0
    for h, body in parse_warc(io.BufferedReader(_Pieces(x.as_buffer().to_pybytes() for batch in batches for x in batch.column(0)), 1 << 20)):
        payload = http_payload(body)[1] if h["Content-Type"].startswith("application/http") else body
        digest, n = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
        if h["WARC-Type"] == "response" and (len(payload) != n or payload_digest(payload) != digest):
            raise ValueError(f"the payload of {h['WARC-Record-ID']} isn't the one that its digest names")
        rows.append((int(h["X-Source-Key"]), n, digest, h["WARC-Type"], int(h["X-Refers-To-Key"]) if "X-Refers-To-Key" in h else None, h["WARC-Target-URI"], h["WARC-Record-ID"], h["WARC-Date"], payload))
        size += len(payload)
        if len(rows) >= 500 or size > 8_000_000:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 2000) -> None:
    """Writes pages (page_id, url, html) as gzipped WARC files under path, by way of legacy ARC records.

    Of records with equal payloads of at least min_bytes bytes that with the smallest page_id is the response and the
    others revisit it; smaller ones are all responses. A null html has an empty payload; rows with a null page_id are
    left out; a repeated page_id with one payload gives repeated responses, with several payloads a record each.
    Every file holds at most records_per_file records, and is read as a stream.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html")).where("page_id is not null")
    keyed = pages.select("page_id", "url", "html", F.sha2("html", 256).alias("key"))
    first = pages.where(F.length("html") >= min_bytes).groupBy(F.sha2("html", 256).alias("key")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Only payloads that repeat are looked up. Their table may be large and its keys hot: Spark splits skewed partitions of this join.
    placed = keyed.join(first, "key", "left").select("page_id", "url", "html", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))
    records = placed.mapInArrow(_to_arc, "page_id long, arc binary, refers_to long").mapInArrow(_convert, "record binary")
    # The text sink writes the bytes as they are, and the separator it puts after each row is what ends a WARC record.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def read_warc(spark, path: str) -> DataFrame:
    """A row for each record of the gzipped WARC files under path: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, record_id, date, content (the payload; empty for a revisit).

    Files are read as a stream of pieces that the blank lines after records, or in them, cut; gzipped files aren't
    split, and a file of any size is held a record at a time.
    """
    pieces = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "*.gz").text(path)
    return pieces.select(F.col("value").cast("binary")).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, date string, content binary")


def archive_roundtrip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages as WARC files in the shared folder and gives what reading them back finds; see write_warc."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, min_bytes)
    return read_warc(spark, path)
