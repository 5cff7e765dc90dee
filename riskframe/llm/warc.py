"""Legacy archives (ARC versions 1 and 2) into WARC 1.1, and WARC back into rows.

ARC: a version block names the archive and its header fields; then each record is a line feed, a header line (five fields in
version 1, ten in version 2, the last the declared length) and that many bytes. WARC records get what ARC lacks:

* WARC-Record-ID: a name-based UUID of the archive's name and the record's offset in it
* WARC-Date: the 14-digit date as an instant
* WARC-Type: ``response`` for HTTP messages, ``revisit`` for repeated payloads, ``resource`` for anything else
* WARC-Payload-Digest and WARC-Block-Digest: SHA-1 in base 32

Archives are written by Spark's text writer (a record is a row, the bytes between records its line separator) and read by its
binary file reader, so they can live in any store that Spark reaches. Each task writes one file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import small_side, written
from riskframe.session import checkpoint_root

CAPTURE_DATE = "20240101000000"
SOURCE_IP = "0.0.0.0"
KEY_HEADER = "X-Page-Id"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS_V1 = "URL IP-address Archive-date Content-type Archive-length"
FIELDS_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
BATCH_BYTES = 4 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def http_message(key: int | None, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{KEY_HEADER}: {'' if key is None else key}\r\n\r\n"
    return head.encode() + payload


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(head with its empty line, payload, header fields by lower-case name) of an HTTP message."""
    end = block.find(b"\r\n\r\n")
    head = block if end < 0 else block[: end + 4]
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.decode("latin-1").strip().lower()] = value.decode("latin-1").strip()
    return head, block[len(head) :], fields


# ---- ARC -------------------------------------------------------------------------------------------------------------


def version_block(name: str, version: int) -> bytes:
    body = f"{version} 0 riskframe\n{FIELDS_V1 if version == 1 else FIELDS_V2}\n\n".encode()
    head = f"filedesc://{name} {SOURCE_IP} {CAPTURE_DATE} text/plain"
    return f"{head} {len(body)}\n".encode() + body if version == 1 else f"{head} 200 - - 0 {name} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, message: bytes, name: str, offset: int) -> bytes:
    head = f"{url} {SOURCE_IP} {CAPTURE_DATE} text/html"
    if version == 1:
        return f"{head} {len(message)}\n".encode() + message
    return f"{head} 200 {hashlib.md5(message).hexdigest()} - {offset} {name} {len(message)}\n".encode() + message


def _to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    name, version = f"pages-{part:05d}.arc", 1 + part % 2
    first = version_block(name, version)
    rows, size, offset = [first], 0, len(first) + 1
    for batch in batches:
        for key, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            address = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:none") or "urn:none"
            record = arc_record(version, address, http_message(key, (html or "").encode()), name, offset)
            rows.append(record)
            size += len(record)
            offset += len(record) + 1
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])


def write_arc(pages: DataFrame, path: str) -> None:
    """ARC archives of ``pages(page_id, url, html)``, versions 1 and 2 by turns."""
    archives = pages.mapInArrow(_to_arc, "value binary").select(F.col("value").cast("string"))
    archives.write.option("lineSep", "\n").option("compression", "gzip").text(path)


def parse_arc(data: bytes) -> Iterator[tuple[str, int, list[str], bytes]]:
    """(archive's name, offset, header fields, content) of each record after the version block."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, name, width = 0, "", 0
    while at < len(data):
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        fields = data[at:end].decode("utf-8", "surrogateescape").split(" ")
        length = int(fields[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ValueError(f"record at {at} of {name} ends early")
        if fields[0].startswith("filedesc://"):
            name = fields[0].removeprefix("filedesc://")
            width = len(content.split(b"\n")[1].split())
        elif len(fields) != width:
            raise ValueError(f"record at {at} of {name} has {len(fields)} header fields, not {width}")
        else:
            yield name, at, fields, content
        at = end + 1 + length


RECORD_SCHEMA = (
    "record_id string, page_id long, url string, ip string, date string, mime string, payload_digest string, payload_bytes long, block binary"
)


def record_of(name: str, offset: int, fields: list[str], content: bytes) -> tuple:
    url, ip, stamp, mime = fields[:4]
    _, payload, http = split_http(content) if content.startswith(b"HTTP/") else (b"", content, {})
    key = http.get(KEY_HEADER.lower(), "")
    date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
    record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}"
    return record_id, int(key) if key else None, url, ip, date, mime, sha1_base32(payload), len(payload), content


def _arc_records(with_block: bool):
    names = ["record_id", "page_id", "url", "ip", "date", "mime", "payload_digest", "payload_bytes"] + ["block"] * with_block
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64()] + [pa.binary()] * with_block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for found in parse_arc(content.as_py()):
                    rows.append(record_of(*found)[: len(names)])
                    size += len(found[3])
                    if size > BATCH_BYTES:
                        yield _batch(rows, names, kinds)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names, kinds)

    return run


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_arc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    schema = RECORD_SCHEMA if with_block else RECORD_SCHEMA.rpartition(",")[0]
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_arc_records(with_block), schema)


# ---- WARC ------------------------------------------------------------------------------------------------------------


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    lines = [f"{k}: {v}" for k, v in fields if v is not None] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogateescape") + block


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    info = b"software: riskframe\r\nformat: WARC File Format 1.1\r\n"
    rows = [
        warc_record(
            [
                ("WARC-Type", "warcinfo"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'pages-{part:05d}.warc')}>"),
                ("WARC-Date", "2024-01-01T00:00:00Z"),
                ("WARC-Filename", f"pages-{part:05d}.warc"),
                ("Content-Type", "application/warc-fields"),
            ],
            info,
        )
    ]
    size = 0
    for batch in batches:
        for r in batch.to_pylist():
            block, http = r["block"], r["block"].startswith(b"HTTP/")
            kind = "revisit" if r["revisit"] else "response" if http else "resource"
            if kind == "revisit":
                block = split_http(block)[0] if http else b""
            head = [
                ("WARC-Type", kind),
                ("WARC-Record-ID", f"<{r['record_id']}>"),
                ("WARC-Date", r["date"]),
                ("WARC-Target-URI", r["url"]),
                ("WARC-IP-Address", r["ip"]),
                ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
                ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
                ("Content-Type", "application/http; msgtype=response" if http else r["mime"]),
            ]
            if kind == "revisit":
                head += [
                    ("WARC-Profile", REVISIT_PROFILE),
                    ("WARC-Refers-To", f"<{r['lead_record_id']}>"),
                    ("WARC-Refers-To-Target-URI", r["lead_url"]),
                    ("WARC-Refers-To-Date", r["lead_date"]),
                ]
            rows.append(warc_record(head, block))
            size += len(block)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_revisit_bytes: int = 0) -> None:
    """WARC archives of the ARC archives' records.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, those of the largest page id are responses and
    the others revisit one of them. The payloads are grouped by digest in a first pass over the headers and digests alone;
    only digests with several records take part in the second.
    """
    lead = F.max_by(F.struct("record_id", "url", "date"), F.struct("page_id", "record_id"))
    leads = written(
        read_arc(spark, arc_path, with_block=False)
        .where(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("payload_digest")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_page"), lead.alias("_lead"))
        .where("_n > 1")
        .select("payload_digest", "_page", F.col("_lead.record_id").alias("lead_record_id"), F.col("_lead.url").alias("lead_url"), F.col("_lead.date").alias("lead_date"))
    )
    records = read_arc(spark, arc_path).join(small_side(leads), "payload_digest", "left")
    revisit = F.col("lead_record_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_page"))
    archives = records.withColumn("revisit", revisit).drop("_page").mapInArrow(_to_warc, "value binary").select(F.col("value").cast("string"))
    archives.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, length = end + 4, int(fields["content-length"])
        block = data[start : start + length]
        if len(block) < length or data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} doesn't end where it says")
        yield fields, block
        at = start + length + 4


WARC_SCHEMA = "page_id long, record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to_id string"


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in WARC_SCHEMA.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in parse_warc(content.as_py()):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
                    raise ValueError(f"block of {fields['warc-record-id']} doesn't match its digest")
                _, payload, http = split_http(block) if block.startswith(b"HTTP/") else (b"", block, {})
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if kind != "revisit" and digest != sha1_base32(payload):
                    raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                key = http.get(KEY_HEADER.lower(), "")
                size = int(http.get("content-length", 0)) if kind == "revisit" else len(payload)
                refers = fields.get("warc-refers-to", "").strip("<>") or None
                rows.append((int(key) if key else None, fields["warc-record-id"].strip("<>"), kind, fields["warc-target-uri"], digest, size, refers))
            if rows:
                yield _batch(rows, names, kinds)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record but warcinfo; digests are checked against the bytes."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_warc_rows, WARC_SCHEMA)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Pages through both formats: ARC archives are written, converted to WARC and read back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to (the page id of the response that a
    revisit names). A null html is an empty payload, and equal payloads are grouped whatever their length. A null url is
    archived as ``urn:none``; blanks in urls are percent-encoded. Rows of one id and payload are all responses if the id is
    the largest; a null id ranks below all ids. An empty table gives no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), arc)
    convert_arc(spark, arc, warc, min_revisit_bytes)
    rows = written(read_warc(spark, warc))
    named = rows.join(
        rows.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).join(
            rows.select("refers_to_id").distinct(), "refers_to_id", "left_semi"
        ),
        "refers_to_id",
        "left",
    )
    return named.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
