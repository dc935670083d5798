"""Legacy ARC archives: written, parsed, and converted to WARC archives whose copies are revisit records.

Archives are real files: every record is a gzip member of its own, files are written and committed by Spark (so those of
lost tasks are replaced) and hold a bounded number of bounded chunks. Between two chunks stands an empty member, which
readers skip.

An ARC file begins with a version block; its first line is a record header, the second names the version, the third the
fields of the headers that follow. A header ends with the length of what it announces, so records are cut by length and
not by their content. A line that cannot be a header is reported as a problem and reading goes on with the next line; a
body that ends early is kept and marked "truncated".
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.llm.common import saved, small

#: The field line of each version of the format (fixed values).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: The profile of revisits of equal payloads (fixed value).
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Copies of payloads of fewer bytes are kept as they are.
LEAST_COPY = 100
#: A chunk is closed at so many packed bytes, a file at so many chunks.
CHUNK, CHUNKS_PER_FILE = 1 << 20, 32
#: So many revisits (two identifiers each) may be broadcast; more are joined by a shuffle.
BROADCAST_REVISITS = 200_000
#: The header of an archived response that carries a record's key.
KEY_HEADER = "X-Record-Key"

RECORD = """file string, place long, record_id string, version int, warc_type string, warc_date string, url string, ip string, mime string,
    status int, record_key string, head binary, payload binary, payload_bytes long, payload_digest string, problem string"""
WARC_RECORD = """file string, place long, record_id string, warc_type string, warc_date string, url string, refers_to string, record_key string,
    payload binary, payload_bytes long, payload_digest string, problem string"""

_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def packed(data: bytes) -> bytes:
    """One gzip member."""
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def unpacked(content: bytes) -> BinaryIO:
    """The bytes of an archive as a stream, whether it is packed or not."""
    return gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _batch(rows: list[dict[str, Any]], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in fields], [n for n, _ in fields])


def _batches(rows: Iterator[dict[str, Any]], schema: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most 1,000 rows, closed at so many bytes of payload."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("payload") or b"")
        if len(held) == 1000 or size >= most:
            yield _batch(held, schema)
            held, size = [], 0
    yield _batch(held, schema)


def _chunks(records: Iterator[bytes], opening: bytes | None = None) -> Iterator[pa.RecordBatch]:
    """Packed records joined to chunks; the first of every file begins with its opening record."""
    held, size, number = [], 0, 0
    for record in records:
        if not held and number % CHUNKS_PER_FILE == 0 and opening:
            held.append(packed(opening))
        held.append(packed(record))
        size += len(held[-1])
        if size >= CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])
            held, size, number = [], 0, number + 1
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])


def _write(chunks: DataFrame, path: str) -> None:
    """One line of the text writer is one chunk, its line end an empty gzip member."""
    lines = chunks.select(F.col("chunk").cast("string").alias("value")).write
    lines.option("lineSep", packed(b"").decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", CHUNKS_PER_FILE).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


# ARC


def _escaped(text: str | None) -> bytes:
    """Text for a place in a header line: white space and control characters are percent-encoded, nothing is "-"."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (text or "").encode("utf-8", "replace")) or b"-"


def arc_opening(version: int, name: str, date: str) -> bytes:
    """The version block of a file."""
    fields = f"{version} 0 portcullis\n{ARC_FIELDS[version]}\n".encode()
    more = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(fields)}\n".encode() + fields + b"\n"


def arc_record(version: int, name: str, date: str, key: Any, url: str | None, payload: bytes) -> bytes:
    """One archived response."""
    keyed = b"" if key is None else b"%s: %s\r\n" % (KEY_HEADER.encode(), _escaped(str(key)))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(payload), keyed)
    more = b"" if version == 1 else b"200 - - 0 %s " % name.encode()
    return b"%s 0.0.0.0 %s text/html %s%d\n" % (_escaped(url), date.encode(), more, len(head) + len(payload)) + head + payload + b"\n"


def write_arc(pages: DataFrame, key_col: str, url_col: str, html_col: str, path: str, date: str = "20240101000000") -> None:
    """Archives a table of pages as ARC files at path; tasks alternate between the versions of the format.

    A null html is an empty payload, a null url is written as "-", a null key is left out. Rows that repeat are archived
    as often as they occur. date (14 digits) is when the pages count as fetched. Other columns are not archived.
    """
    rows = pages.select(F.col(key_col).alias("key"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))

    def pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc"
        records = (arc_record(version, name, date, k.as_py(), u.as_py(), h.as_py()) for b in batches for k, u, h in zip(*b.columns, strict=True))
        yield from _chunks(records, arc_opening(version, name, date))

    _write(rows.mapInArrow(pack_part, "chunk binary"), path)


def _header(line: bytes, fields: list[str]) -> dict[str, str] | None:
    """The fields of a record header, or None if the line cannot be one. Only the url may hold spaces."""
    parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)
    found = dict(zip(fields, parts, strict=False))
    whole = len(parts) == len(fields) and found["Archive-length"].isascii() and found["Archive-length"].isdigit()
    return found if whole and re.fullmatch("[0-9]{8,14}", found["Archive-date"]) else None


def _iso(digits: str) -> str | None:
    """The date of a WARC record; digits that are no date give none."""
    try:
        return datetime.strptime(digits.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and payload of a response; a body without a head is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = re.search(rb"\r?\n\r?\n", body)
    return (body[: end.end()], body[end.end() :]) if end else (body, b"")


def _http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^%s:[ \t]*([^\r\n]*)" % re.escape(name.encode()), head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def parse_arc(name: str, content: bytes) -> Iterator[dict[str, Any]]:
    """The records of one ARC file with what their WARC records need.

    The identifier is derived from the file's name and the record's place in it, the type from the url and the body
    (warcinfo for the version block, response for HTTP, resource for all else), the digest from the payload.
    """
    stream, place, version, fields = unpacked(content), 0, 1, ARC_FIELDS[1].split()
    while line := stream.readline():
        began, place = place, place + len(line)
        if not line.strip():
            continue
        # Before the field line is known, a version block may have the header of either version.
        opening = began == 0 and line.startswith(b"filedesc://")
        found = next((h for f in map(str.split, ARC_FIELDS.values()) if (h := _header(line, f)) and line.count(b" ") == len(f) - 1), None) if opening else _header(line, fields)
        row = {"file": name, "place": began, "record_id": f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{name}:{began}'.encode()).hexdigest())}>"}
        if not found:
            yield row | {"version": version, "problem": "no header"}
            continue
        size = int(found["Archive-length"])
        body = stream.read(size)
        place += len(body)
        if opening:
            lines = body.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0]) if lines and lines[0].split()[:1] and lines[0].split()[0].isdigit() else 1
            named = lines[1].split() if len(lines) > 1 else []
            fields = named if {"Archive-date", "Archive-length"} <= set(named) else ARC_FIELDS.get(version, ARC_FIELDS[1]).split()
        head, payload = http_parts(body)
        status = re.match(rb"HTTP/\S+ (\d{3})", head)
        yield row | {
            "version": version,
            "warc_type": "warcinfo" if opening else "response" if head else "resource",
            "warc_date": _iso(found["Archive-date"]),
            "url": None if found["URL"] == "-" else found["URL"],
            "ip": found.get("IP-address"),
            "mime": found.get("Content-type"),
            "status": int(status[1]) if status else None,
            "record_key": _http_field(head, KEY_HEADER),
            "head": head,
            "payload": payload,
            "payload_bytes": len(payload),
            "payload_digest": hashlib.sha256(payload).hexdigest(),
            "problem": "truncated" if len(body) < size else None,
        }


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records (RECORD) of all ARC files below path; without payloads, only what describes them is returned."""

    def parse_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for name, content in zip(*b.columns, strict=True) for r in parse_arc(name.as_py(), content.as_py()))
        yield from _batches(rows if payloads else (r | {"payload": None, "head": None} for r in rows), RECORD)

    return _files(spark, path).mapInArrow(parse_part, RECORD)


# Conversion


def revisits(described: DataFrame, least: int = LEAST_COPY) -> DataFrame:
    """The responses (record_id) that repeat the payload of another one (refers_to).

    Of responses with equal digests of at least so many bytes, that with the smallest key stays; keys that are numbers
    are compared as such and come before others, null keys come last, and place decides between equal keys. Equal
    digests are counted where they are read, and only those of several responses meet the responses again.
    """
    shown = described.where((F.col("warc_type") == "response") & (F.col("payload_bytes") >= least))
    number = F.expr("try_cast(record_key as bigint)")
    order = F.struct(F.col("record_key").isNull(), number.isNull(), number, "record_key", "file", "place", "record_id")
    firsts = shown.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").select("payload_digest", F.col("first.record_id").alias("refers_to"))
    return shown.select("payload_digest", "record_id").join(firsts, "payload_digest").where("record_id <> refers_to").select("record_id", "refers_to")


def converted(spark: SparkSession, path: str) -> DataFrame:
    """The WARC records of all ARC files below path: RECORD with refers_to, revisits without payload.

    Headers that could not be parsed have no record here; read_arc() shows them. The archives are read twice: once for
    digests and once for payloads, so payloads are shuffled only if there are too many revisits to broadcast; that join
    is by identifiers that do not repeat.
    """
    again = saved(revisits(saved(read_arc(spark, path, payloads=False), "arc-index")), "revisits")
    records = read_arc(spark, path).where("warc_type is not null").join(small(again, BROADCAST_REVISITS), "record_id", "left")
    copy = F.col("refers_to").isNotNull()
    return records.withColumn("payload", F.when(~copy, F.col("payload"))).withColumn("warc_type", F.when(copy, "revisit").otherwise(F.col("warc_type")))


# WARC


def warc_record(row: dict[str, Any]) -> bytes:
    """One record with its headers; row has the columns of converted()."""
    block = (row["head"] or b"") + (row["payload"] or b"")
    http = row["warc_type"] in ("response", "revisit")
    named = {
        "WARC-Type": row["warc_type"],
        "WARC-Record-ID": row["record_id"],
        "WARC-Date": row["warc_date"] or "1970-01-01T00:00:00Z",
        "WARC-Target-URI": row["url"] if row["warc_type"] != "warcinfo" else None,
        "WARC-IP-Address": row["ip"] if row["ip"] not in (None, "", "-", "0.0.0.0") else None,
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Profile": REVISIT_PROFILE if row["warc_type"] == "revisit" else None,
        "WARC-Refers-To": row["refers_to"],
        "WARC-Truncated": "unspecified" if row["problem"] else None,
        "X-Payload-Length": str(row["payload_bytes"]),
        "Content-Type": "application/http;msgtype=response" if http else (row["mime"] or "application/octet-stream"),
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {re.sub('[\r\n]+', ' ', v)}\r\n" for k, v in named.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    """Writes the records of converted() as WARC files at path; every file begins with a warcinfo record."""
    columns = ["record_id", "warc_type", "warc_date", "url", "ip", "mime", "head", "payload", "payload_bytes", "payload_digest", "refers_to", "problem"]

    def pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = b"software: portcullis\r\nformat: WARC File Format 1.1\r\n"
        info = {"warc_type": "warcinfo", "record_id": f"<urn:uuid:{uuid.uuid4()}>", "mime": "application/warc-fields", "payload": about}
        info |= {"payload_bytes": len(about), "payload_digest": hashlib.sha256(about).hexdigest()}
        records = (warc_record(dict(zip(columns, (v.as_py() for v in row), strict=True))) for b in batches for row in zip(*b.columns, strict=True))
        yield from _chunks(records, warc_record(dict.fromkeys(columns) | info))

    _write(records.select(*columns).mapInArrow(pack_part, "chunk binary"), path)


def parse_warc(name: str, content: bytes) -> Iterator[dict[str, Any]]:
    """The records of one WARC file; digests of full payloads are taken anew, those of revisits come from their headers."""
    stream, place = unpacked(content), 0
    while line := stream.readline():
        began, place = place, place + len(line)
        if not line.strip():
            continue
        row = {"file": name, "place": began}
        if not line.startswith(b"WARC/"):
            yield row | {"problem": "no header"}
            continue
        named: dict[str, str] = {}
        while (line := stream.readline()).strip():
            place += len(line)
            field, _, value = line.decode("utf-8", "replace").partition(":")
            named[field.strip().lower()] = value.strip()
        place += len(line)
        size = int(named["content-length"]) if named.get("content-length", "").isdigit() else 0
        block = stream.read(size)
        place += len(block)
        kind, stated = named.get("warc-type"), named.get("warc-payload-digest", "").removeprefix("sha256:") or None
        head, payload = http_parts(block)
        revisit = kind == "revisit"
        length = named.get("x-payload-length", "")
        digest = stated if revisit else hashlib.sha256(payload).hexdigest()
        yield row | {
            "record_id": named.get("warc-record-id"),
            "warc_type": kind,
            "warc_date": named.get("warc-date"),
            "url": named.get("warc-target-uri"),
            "refers_to": named.get("warc-refers-to"),
            "record_key": _http_field(head, KEY_HEADER),
            "payload": None if revisit else payload,
            "payload_bytes": (int(length) if length.isdigit() else None) if revisit else len(payload),
            "payload_digest": digest,
            "problem": "truncated" if len(block) < size else "digest" if stated not in (None, digest) else None,
        }


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records (WARC_RECORD) of all WARC files below path; a digest that does not fit its payload is a problem."""

    def parse_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for name, content in zip(*b.columns, strict=True) for r in parse_warc(name.as_py(), content.as_py()))
        yield from _batches(rows if payloads else (r | {"payload": None} for r in rows), WARC_RECORD)

    return _files(spark, path).mapInArrow(parse_part, WARC_RECORD)


def pages_of(described: DataFrame) -> DataFrame:
    """Responses and revisits with the key of the response that a revisit refers to (described: saved read_warc())."""
    shown = described.where(F.col("warc_type").isin("response", "revisit"))
    named = shown.where("warc_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("record_key").alias("refers_to_key"))
    return shown.join(named, "refers_to", "left")
