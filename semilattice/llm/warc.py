"""Web archives: a converter of legacy ARC files to WARC, with duplicates of payloads as revisit records.

An ARC file opens with a version block that names the fields of its record lines: version 1 has five, version 2
ten, and the last one is the length of what follows. From these the converter synthesises what WARC asks for: a
record identifier, the capture time in ISO form, the record type, and digests of the block and the payload. Of
records with equal payloads one becomes a response and the others revisit it.

Archives are written and read with Spark's own readers and writers, so any shared file system will do: one gzip
file an archive, of ``archive_bytes`` or one longer record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, bounded_batches, column, give_back, need, texts

#: Bytes in an archive, before compression.
ARCHIVE_BYTES = 8 << 20

#: The names that version blocks give to record lines' fields.
ARC_V1 = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
ARC_V2 = ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of URLs


@dataclass(frozen=True)
class ArcRecord:
    version: int
    offset: int
    url: str
    ip: str
    date: str  # 14 digits
    content_type: str
    block: bytes

    @property
    def http(self) -> bool:
        return self.block.startswith(b"HTTP/")

    @property
    def head(self) -> bytes:
        """The HTTP head with its blank line; empty for other content."""
        if not self.http:
            return b""
        at = self.block.find(b"\r\n\r\n")
        return self.block[: at + 4] if at >= 0 else self.block

    @property
    def payload(self) -> bytes:
        return self.block[len(self.head) :]


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_arc(data: bytes, name: str = "-") -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block excluded. Raises ValueError, with the place, on a bad one."""
    at, version, fields = 0, 0, ARC_V1
    while True:
        while at < len(data) and data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        stop = data.find(b"\n", at)
        parts = data[at : stop if stop >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        if not version and not parts[0].startswith("filedesc:"):
            raise ValueError(f"{name}: no version block")
        if len(parts) != len(fields) and not (not version and len(parts) in (len(ARC_V1), len(ARC_V2))):
            raise ValueError(f"{name}: {len(parts)} fields at byte {at}, version {version} has {len(fields)}")
        if stop < 0 or not parts[-1].isdigit() or stop + 1 + int(parts[-1]) > len(data):
            raise ValueError(f"{name}: a bad length at byte {at}")
        block = data[stop + 1 : stop + 1 + int(parts[-1])]
        if not version:
            lines = block.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0]) if lines[0][:1].isdigit() else 0
            if version not in (1, 2):
                raise ValueError(f"{name}: unknown version {lines[0]!r}")
            fields = tuple(lines[1].strip().split(" ")) if len(lines) > 1 and lines[1].strip() else (ARC_V1, ARC_V2)[version - 1]
        else:
            row = dict(zip(fields, parts, strict=True))
            yield ArcRecord(version, at, row["URL"], row.get("IP-address", "0.0.0.0"), row.get("Archive-date", ""), row.get("Content-type", "application/octet-stream"), block)
        at = stop + 1 + len(block)


def arc_version_block(version: int, name: str, date: str) -> bytes:
    fields = (ARC_V1, ARC_V2)[version - 1]
    body = f"{version} 0 semilattice\n{' '.join(fields)}\n\n".encode()
    row = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(row[f] for f in fields).encode() + b"\n" + body


def arc_record(version: int, url: str, date: str, content_type: str, block: bytes, offset: int = 0, name: str = "-") -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    row = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": content_type, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(row[f] for f in (ARC_V1, ARC_V2)[version - 1]).encode() + b"\n" + block + b"\n"


def _iso(date: str) -> str:
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(r: ArcRecord, page: str) -> str:
    """An identifier that depends on the record's content alone, so that a task run twice writes the same one."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{r.url} {r.date} {page} {sha1_base32(r.block)}')}>"


_PAGE = re.compile(rb"\r\nX-Page-Id: (-?\d+)\r\n")
_SERIAL = re.compile(rb"\r\nX-Row: ([^\r\n]+)\r\n")


def page_of(head: bytes) -> int | None:
    m = _PAGE.search(head)
    return int(m[1]) if m else None


def serial_of(head: bytes) -> str:
    m = _SERIAL.search(head)
    return m[1].decode() if m else ""


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]).encode() + b"\r\n" + block


def convert(r: ArcRecord, revisits: tuple[str, str, str] | None) -> bytes:
    """The WARC record of an ARC record; ``revisits``: the response's identifier, URL and time, if it repeats one."""
    digest = "sha1:" + sha1_base32(r.payload)
    block = r.head if revisits else r.block
    kind = "revisit" if revisits else "response" if r.http else "resource"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(r, serial_of(r.head))), ("WARC-Date", _iso(r.date)), ("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip), ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", "sha1:" + sha1_base32(block))]
    headers.append(("Content-Type", "application/http; msgtype=response" if r.http else r.content_type))
    if revisits:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", revisits[0]), ("WARC-Refers-To-Target-URI", revisits[1]), ("WARC-Refers-To-Date", revisits[2]), ("X-Payload-Length", str(len(r.payload)))]
    return warc_record(headers, block)


def read_warc(data: bytes, name: str = "-") -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record; digests that don't match raise ValueError."""
    at = 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"{name}: no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:stop].decode().split("\r\n")[1:])}
        n = int(headers["content-length"])
        block = data[stop + 4 : stop + 4 + n]
        if len(block) != n:
            raise ValueError(f"{name}: a bad length at byte {at}")
        if (d := headers.get("warc-block-digest")) and d != "sha1:" + sha1_base32(block):
            raise ValueError(f"{name}: a wrong digest at byte {at}")
        yield headers, block
        at = stop + 4 + n


def _gunzip(data: bytes) -> bytes:
    out = []
    while data:
        d = zlib.decompressobj(47)  # gzip, one member after the other
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def _write_archives(archives: DataFrame, path: str, line_end: str) -> None:
    """One row, one file. Compressed fast, since every archive is read again."""
    archives.write.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).option("compression", "gzip").option("lineSep", line_end).text(path)


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20000101000000", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Pages (``page_id, url, html``) as ARC files. The HTTP head carries the page's id, absent where it is null."""
    source = need(pages, page_id="long", url="string", html="string").withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()).cast(pa.string())], ["value"])

        pages_ = (row for b in batches for row in zip(*(column(b, c).to_pylist() for c in ("page_id", "row", "url")), texts(b, "html"), strict=True))
        for i, row, url, html in pages_:
            html = html or b""
            if parts and size + len(html) > archive_bytes:
                yield made()
                parts, size = [], 0
            name = f"pages-{row}.arc"
            if not parts:
                parts.append(arc_version_block(version, name, date))
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Row: {row}\r\n" + (f"X-Page-Id: {i}\r\n" if i is not None else "") + f"Content-Length: {len(html)}\r\n\r\n"
            parts.append(arc_record(version, url or "-", date, "text/html", head.encode() + html, size, name))
            size += len(parts[-1])
        if parts:
            yield made()
        give_back()

    bounded_batches(pages.sparkSession)
    _write_archives(source.mapInArrow(run, "value string"), path, "\n")


def convert_archives(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """Converts every ARC file below a path to a WARC file.

    Of records whose payloads are equal and of at least ``least`` bytes, the one with the smallest page id (the
    records without one last, then by identifier) becomes a response and the others revisit it. Only identifiers
    are shuffled by payload; the archives themselves meet the verdicts of their own records by path.
    """

    def scan(batch: pa.RecordBatch):
        for path, content in zip(column(batch, "path").to_pylist(), column(batch, "content").to_pylist(), strict=True):
            rows = [(path, r.offset, page_of(r.head), record_id(r, serial_of(r.head)), r.url, _iso(r.date), sha1_base32(r.payload), len(r.payload)) for r in read_arc(_gunzip(content), path)]
            yield dict(zip(("path", "at", "page_id", "id", "url", "date", "digest", "n"), map(list, zip(*rows, strict=True)), strict=True)) if rows else None

    scratch = Scratch(spark, "arc")
    seen = scratch.write(arrow_map(_files(spark, arc_path), lambda b: (x for x in scan(b) if x), "path string, at long, page_id long, id string, url string, date string, digest string, n long"), "records")
    rank = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("id"), F.col("url"), F.col("date"))
    firsts = seen.where(F.col("n") >= least).groupBy("digest").agg(F.min(rank).alias("f"), F.count("*").alias("c")).where("c > 1").select("digest", F.col("f.id").alias("rid"), F.col("f.url").alias("rurl"), F.col("f.date").alias("rdate"))
    verdicts = seen.where(F.col("n") >= least).join(firsts, "digest").where("id != rid").groupBy("path").agg(F.collect_list(F.struct("at", "rid", "rurl", "rdate")).alias("revisits"))
    work = _files(spark, arc_path).join(verdicts, "path", "left")

    def run(batch: pa.RecordBatch):
        for path, content, revisits in zip(*(column(batch, c).to_pylist() for c in ("path", "content", "revisits")), strict=True):
            to = {r["at"]: (r["rid"], r["rurl"], r["rdate"]) for r in revisits or ()}
            body = _gunzip(content)
            info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, path)}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: semilattice\r\nformat: WARC File Format 1.0\r\n")
            out = b"\r\n\r\n".join([info, *(convert(r, to.get(r.offset)) for r in read_arc(body, path))])
            yield {"value": pa.array([out], pa.binary()).cast(pa.string())}

    _write_archives(arrow_map(work, run, "value string"), warc_path, "\r\n\r\n")
    scratch.drop(seen)


def read_archives(spark: SparkSession, warc_path: str) -> DataFrame:
    """``page_id, record_id, record_type, payload_bytes, payload_digest, refers_to_id`` of every response and revisit."""

    def run(batch: pa.RecordBatch):
        for path, content in zip(column(batch, "path").to_pylist(), column(batch, "content").to_pylist(), strict=True):
            rows = []
            for h, block in read_warc(_gunzip(content), path):
                if h["warc-type"] == "warcinfo":
                    continue
                end = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                if h["warc-type"] == "revisit":
                    digest, n = h["warc-payload-digest"].partition(":")[2], int(h["x-payload-length"])
                else:
                    digest, n = sha1_base32(block[end:]), len(block) - end
                    if h["warc-payload-digest"] != "sha1:" + digest:
                        raise ValueError(f"{path}: a wrong payload digest")
                rows.append((page_of(block[:end]), h["warc-record-id"], h["warc-type"], n, digest, h.get("warc-refers-to")))
            if rows:
                yield dict(zip(("page_id", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id"), map(list, zip(*rows, strict=True)), strict=True))

    return arrow_map(_files(spark, warc_path), run, "page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to_id string")


def archive_pages(spark: SparkSession, pages: DataFrame, least: int = 0, version: int = 1) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what a reader of the WARC files finds.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``, a row per input row. A null html
    counts as empty, a null url is written as ``-``; a null page_id stays null and never is the response while a
    page with an id has the same payload; of rows repeated with their page_id one is the response. An empty table
    gives an empty result; other columns are not read.
    """
    scratch = Scratch(spark, "archives")
    arc, warc = scratch.path("arc"), scratch.path("warc")
    write_arc(pages, arc, version)
    convert_archives(spark, arc, warc, least)
    scratch.drop(arc)
    found = scratch.write(read_archives(spark, warc), "found")
    pages_of = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return found.join(pages_of, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"))
