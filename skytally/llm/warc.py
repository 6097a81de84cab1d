"""Converting legacy ARC archives to WARC, and writing and reading WARC files.

An ARC archive starts with a version block; its version says which fields the header line of every record has (version 1:
URL, IP address, date, type, length; version 2 adds status, checksum, location, offset and file name before the length).
The declared length, not any separator, ends a record. From these the converter makes WARC records: identifiers are name
based and so the same on every run, dates and types are rewritten, digests are computed from the bytes.

Records with equal payloads of at least ``least`` bytes are stored once: the one with the smallest page_id is a response,
the others are revisits that refer to it. WARC files are written by Spark's own writer (gzip, one file for each task and
``per_file`` records) and read with ``binaryFile``, so that they may lie in any store Spark knows.

Defined results: null html is an empty payload, a null URL is ``-``, white space in URLs is percent-encoded. Rows with
the page_id of the response are responses too (repeated rows); rows without a page_id refer to the response like others,
and if no row of their payload has a page_id all are responses. An archive whose header line or length is wrong raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT = "http://netpreservefoundation.org/warc/1.0/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, ip string, stamp string, mime string, status int, http string, payload binary, payload_bytes long, payload_digest string"
ARCHIVE_BYTES, SALTS = 1 << 20, 16


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def safe_url(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "-"


def arc_archive(version: int, records: list[tuple[str, str, str, str, int, bytes]]) -> bytes:
    """One archive of records (url, ip, date, type, status, content)."""
    block = f"{version} 0 skytally\n{ARC_FIELDS[version]}\n".encode()
    own = " 200 - - 0 pages.arc" if version == 2 else ""
    out = [f"filedesc://pages.arc 0.0.0.0 20000101000000 text/plain{own} {len(block)}\n".encode(), block, b"\n"]
    offset = sum(map(len, out))
    for url, ip, date, mime, status, content in records:
        more = f" {status} {base32_sha1(content)} - {offset} pages.arc" if version == 2 else ""
        out += [head := f"{url} {ip} {date} {mime}{more} {len(content)}\n".encode(), content, b"\n"]
        offset += len(head) + len(content) + 1
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[str, str, str, str, int | None, bytes]]:
    """The records of an archive, without the version block."""
    at, version = 0, None
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace") if end >= 0 else ""
        fields = line.rsplit(" ", (5 if version in (None, 1) else 10) - 1)
        if version is None and len(data) > end >= 0 and not line.startswith("filedesc:"):
            raise ValueError(f"no version block at byte {at}")
        if len(fields) < (5 if version in (None, 1) else 10) or not fields[-1].isdigit() or end + 1 + int(fields[-1]) > len(data):
            raise ValueError(f"wrong header line at byte {at}: {line[:200]!r}")
        content = data[end + 1 : end + 1 + int(fields[-1])]
        at = end + 1 + len(content)
        if version is None:
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown version {version}")
            continue
        status = int(fields[4]) if version == 2 and fields[4].isdigit() else None
        yield fields[0], fields[1], fields[2], fields[3], status, content


def write_arc(pages: DataFrame, stamp: str = "20000101000000") -> DataFrame:
    """Pages (page_id, url, html) as legacy archives of about a MB, versions 1 and 2 in turn: one row ``archive`` each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size, made = [], 0, 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([arc_archive(1 + made % 2, records)], pa.binary())], ["archive"])

        for batch in batches:
            for page_id, url, html in zip(*(column for column in batch.columns)):
                payload = (html.as_py() or "").encode()
                page = "" if page_id.as_py() is None else f"X-Page-Id: {page_id.as_py()}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n"
                records.append((safe_url(url.as_py()), "0.0.0.0", stamp, "text/html", 200, head.encode() + payload))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield full()
                    records, size, made = [], 0, made + 1
        if records:
            yield full()

    return pages.select("page_id", "url", "html").mapInArrow(run, "archive binary")


def split_http(content: bytes) -> tuple[int | None, str, bytes]:
    """Page_id, head and payload of a stored response."""
    head, mark, payload = content.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return None, "", content
    page = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
    return int(page[1]) if page else None, head.decode("latin-1"), payload


def read_arc(archives: DataFrame, column: str = "archive") -> DataFrame:
    """Every record of every archive with its payload's size and digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for value in batch.column(0):
                rows = []
                for url, ip, date, mime, status, content in parse_arc(value.as_py() or b""):
                    page, http, payload = split_http(content)
                    rows.append((page, url, ip, date, mime, status, http, payload, len(payload), base32_sha1(payload)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return archives.select(column).mapInArrow(run, RECORDS)


def mark_revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """Adds ``refers_to``: for revisits the page_id of the response with the same payload.

    The smallest page_id of each payload is found by partial sums; only payloads found twice are joined back, and the
    records of one payload are dealt over ``SALTS`` tasks.
    """
    first = (
        records.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__rows"))
        .where("__rows > 1 AND __first IS NOT NULL")
        .select("payload_digest", "payload_bytes", "__first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    )
    salted = records.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, ["payload_digest", "payload_bytes", "__salt"], "left")
    return joined.select(*records.columns, F.when(~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first")).alias("refers_to"))


def warc_record(page_id: int | None, url: str, ip: str, stamp: str, http: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record without the two line ends that close it."""
    date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
    block = (http.encode("latin-1") + b"\r\n\r\n" if http else b"") + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if http else 'application/octet-stream'}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str, per_file: int = 5000) -> None:
    """Write records with ``refers_to`` as gzip WARC files below ``path``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(column for column in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array([warc_record(*(x.as_py() for x in row)) for row in rows], pa.binary())], ["value"])

    columns = ["page_id", "url", "ip", "stamp", "http", "payload", "payload_digest", "refers_to"]
    made = records.select(*columns).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of a file; gzip files are unpacked first."""
    while data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest[:2] == b"\x1f\x8b":
            unpack = zlib.decompressobj(31)
            parts += [unpack.decompress(rest), unpack.flush()]
            rest = unpack.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        at = end + 4 + int(fields["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"wrong length of the record before byte {at}")
        yield fields, data[end + 4 : at]
        at += 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, url, record_type, payload (null for revisits), its size and digest, refers_to.

    A response whose payload does not have the digest of its header raises ValueError.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows = []
                for fields, block in parse_warc(value.as_py()):
                    page, http, payload = split_http(block)
                    digest, full = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "response"
                    if full and base32_sha1(payload) != digest:
                        raise ValueError(f"wrong payload digest of {fields['warc-record-id']}")
                    size = len(payload) if full else int(re.search(r"Content-Length: (\d+)", http)[1])
                    to = fields.get("x-refers-to-page")
                    rows.append((page, fields["warc-target-uri"], fields["warc-type"], size, digest, None if to is None else int(to), payload if full else None))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, schema)


def convert(archives: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Convert ARC archives to WARC files below ``path`` and read these back."""
    write_warc(mark_revisits(read_arc(archives), least), path)
    return read_warc(archives.sparkSession, path)
