"""WARC archives: writing with duplicate revisits, and a splittable reader.

Archives are files of gzip members, one record each.  The writer runs in
tasks, one archive per task; a record whose payload equals an earlier one's
(SHA-256, at least ``min_bytes`` long) is written as a ``revisit`` without
payload.  Which page is first comes from a partial aggregate over digests and
a salted join, so a third of all pages may share one payload.

The reader needs no index.  Files are cut into byte ranges, a task per range.
A task scans its range for the gzip magic, takes a hit for a member only if
its first bytes decode to a WARC header, and owns the records that start
inside the range; it reads past the range's end to finish its last record.

Files live in the shared folder and are opened by URI through Arrow's file
systems (file, hdfs, s3, gs), in the tasks alone.  Names hold the task
attempt; only archives listed in the manifest, which Spark's writer commits,
are read, so lost and repeated tasks leave nothing behind that counts.

Defined results: a null html is the empty payload; a null url the empty URI.
Rows that repeat a page_id are written each; among equal payloads every row
with the smallest id is a response.  A null id is always a response.  An empty
table gives no archive and an empty result.  A member that begins as a record
but is damaged, lacks a mandatory header or does not fit its length or digest
gives a row of record type ``malformed`` with its path and offset alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import join_checked
from fleetlens.session import fresh_folder, write_shared

#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.0\r\n"
SALTS = 16

RECORD = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, path string, offset long"


def file_system(uri: str):
    """Arrow file system and path of a URI or of an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else re.sub(r"^(\w+):/*", r"\1:///", uri))


def with_first(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """page_id, payload, digest, refers_to (null: response).

    Equal payloads are found by ids and digests alone, in salted parts; only the
    pages that revisit another meet the payloads, by their id."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col("uri"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    keys = write_shared(rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest").where("page_id is not null"), "warc-digests")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = keys.where("page_id is not null").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    again = salted.join(first, ["digest", "salt"]).where(F.col("first") < F.col("page_id")).select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    return join_checked(rows, write_shared(again, "warc-revisits"), ["page_id", "digest"], "left")


def record_bytes(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record: header lines, blank line, block, two line ends.  The block is
    an HTTP response, without its body in a revisit."""
    name = "none" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        # header lines end at CR LF; such characters cannot stand in a URI
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', uri or '')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", min_bytes: int = 100, date: str | None = None) -> DataFrame:
    """Write the archives below ``folder``; returns the manifest (path, length,
    records).  ``date`` is the pages' time (ISO 8601, UTC; now if not given)."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        path, out, records, length = f"{base}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for b in batches:
            for row in b.to_pylist():
                out = out or system.open_output_stream(path, compression=None)  # by default .gz would be compressed again
                data = gzip_member(record_bytes(row["page_id"], row["uri"], row["payload"], row["digest"], row["refers_to"], date))
                out.write(data)
                records += 1
                length += len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path.rsplit("/", 1)[1]], "length": pa.array([length], pa.int64()), "records": pa.array([records], pa.int64())})

    named = pages.select(F.col(id_col), F.col(payload_col), F.col(uri_col).alias("uri"))
    rows = with_first(named, id_col, payload_col, min_bytes)
    manifest = write_shared(rows.mapInArrow(run, "path string, length long, records long"), "warc-manifest")
    return manifest.select(F.concat(F.lit(folder + "/"), "path").alias("path"), "length", "records")


class _Window:
    """Bytes of a file from an offset on, read as needed."""

    def __init__(self, source, start: int, length: int) -> None:
        self.source, self.start, self.length = source, start, length
        self.data = bytearray()  # grows in place

    def upto(self, end: int, step: int = 1 << 20) -> bool:
        """Have bytes before ``end`` (or the file's end)."""
        while self.start + len(self.data) < min(end, self.length):
            at = self.start + len(self.data)
            got = self.source.read_at(min(step, self.length - at), at)
            if not got:
                raise EOFError("archive is shorter than its manifest says")
            self.data += got
        return end <= self.length

    def drop(self, before: int) -> None:
        del self.data[: before - self.start]
        self.start = before


def member_at(view: _Window, at: int, probe: int | None = None) -> tuple[bytes, int] | None:
    """Data and end offset of the gzip member at ``at``; None if it is none.
    With ``probe`` only its first bytes are decoded."""
    d, out, pos, step = zlib.decompressobj(31), [], at, 1 << 16
    try:
        while not d.eof:
            view.upto(pos + step)
            chunk = bytes(view.data[pos - view.start : pos - view.start + step])
            if not chunk:
                return None
            out.append(d.decompress(chunk, probe or 0))
            if probe:
                return b"".join(out), pos
            pos += len(chunk)
    except zlib.error:
        return None
    return b"".join(out), pos - len(d.unused_data)


def headers(data: bytes) -> dict[str, str]:
    """Header fields of the lines before the first blank one."""
    head = data.partition(b"\r\n\r\n")[0].decode("utf-8", "replace")
    return dict(line.split(": ", 1) for line in head.split("\r\n")[1:] if ": " in line)


def parse_record(data: bytes) -> dict | None:
    """Header fields, HTTP block and body of one record; None if a header that
    every record has is missing or does not fit the block."""
    fields, block = headers(data), data.partition(b"\r\n\r\n")[2]
    size = fields.get("Content-Length", "")
    if not size.isdigit() or not {"WARC-Type", "WARC-Record-ID", "WARC-Date"} <= fields.keys() or len(block) != int(size) + 4:
        return None
    return fields | {"http": headers(block), "body": block[: int(size)].partition(b"\r\n\r\n")[2]}


def records_in(source, start: int, end: int, length: int) -> Iterator[tuple[int, bytes]]:
    """Offset and data of every record that starts in [start, end)."""
    view, at = _Window(source, start, length), start
    while at < end:
        view.drop(at)
        view.upto(min(end + len(MAGIC) - 1, at + (1 << 20)))
        hit = view.data.find(MAGIC)
        if hit < 0:
            at = max(at + 1, view.start + len(view.data) - len(MAGIC) + 1)
            continue
        at = view.start + hit
        if at >= end:
            return
        head = member_at(view, at, probe=len(VERSION))
        whole = member_at(view, at) if head and head[0] == VERSION else None
        if whole:
            yield at, whole[0]
            at = whole[1]
            continue
        if head and head[0] == VERSION:  # a record, but its member is damaged
            yield at, b""
        at += 1  # else the magic inside compressed data


def read_archives(spark: SparkSession, manifest: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """Records of the archives in ``manifest`` (path, length), split by byte ranges."""
    ranges = manifest.select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start")
    )
    n = max(1, ranges.count())
    ranges = ranges.repartition(n)  # a task for each range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())]
            + [("payload_digest", pa.string()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())]
        )
        for b in batches:
            for r in b.to_pylist():
                system, path = file_system(r["path"])
                rows, held = [], 0
                with system.open_input_file(path) as source:
                    for offset, data in records_in(source, r["start"], min(r["start"] + range_bytes, r["length"]), r["length"]):
                        rows.append(_row(data) | {"path": r["path"], "offset": offset})
                        held += len(data)
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(run, RECORD)


def _row(data: bytes) -> dict:
    def page(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
        return int(found[1]) if found else None

    record = parse_record(data)
    nothing = dict.fromkeys(("page_id", "uri", "refers_to", "payload_bytes", "payload_digest", "payload"))
    if record is None or record["WARC-Type"] not in ("response", "revisit"):
        return nothing | {"record_type": "malformed" if record is None else record["WARC-Type"]}
    body, kind = record["body"], record["WARC-Type"]
    digest = record.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    size = record["http"].get("Content-Length", "")
    if not size.isdigit() or (kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(size))):
        return nothing | {"record_type": "malformed"}
    return {
        "page_id": page(record["WARC-Record-ID"]),
        "uri": record.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": page(record.get("WARC-Refers-To")),
        "payload_bytes": int(size),
        "payload_digest": digest,
        "payload": body if kind == "response" else None,
    }


def round_trip(spark: SparkSession, pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` into a new folder of the shared one and read them back."""
    folder = fresh_folder(spark, "warc")
    return read_archives(spark, write_archives(pages, folder, **columns))
