"""Legacy web archives: ARC files are parsed and converted to WARC, and WARC files are read.

An ARC file begins with a version block. Its second line says the version, its third the fields of the
header lines: version 1 has URL, address, date, type and length; version 2 adds status, checksum,
location, offset and file name. A record is a header line, as many bytes as it declares, and a line
feed. The converter takes each record as far as its declared length, whatever the bytes are, and makes
a WARC record of it: an identifier that is a name-based UUID of address, date and the record's place (file and
offset, or a name that the caller gives), the date in ISO form, a type (response if the bytes begin with an HTTP
status line, else resource; the version block becomes warcinfo) and SHA-1 digests of block and payload. Where it is
told that another record holds the same payload, the record becomes a revisit that refers to that record's identifier,
address and date; its block keeps the HTTP header alone.

The pages operator writes pages as ARC, converts them and writes WARC files of bounded size, one member
a record, into the shared folder, then reads the files back. A page's record is named by its id and payload, so that
reruns and other partitionings give the same identifiers. Tasks write under a name of their own and
rename at the end, so that a task that is run again replaces its files. Payload digests that several pages have are
found from digests alone, with partial sums; only they are joined to the pages, broadcast up to BROADCAST_DIGESTS of
them and shuffled beyond.

Null html is an empty payload. Rows with the smallest page_id of a payload are responses, also if that id is repeated
(rows repeated exactly are the same capture under one identifier); null ids count as larger than all others. A null or
odd url is percent-encoded. Very long payloads are written and read whole. Other columns, whatever their names, aren't
read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh_dir, in_arrow

#: Uncompressed bytes after which a new file begins.
ROTATE = 24 << 20
#: The field lines of the two versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE = "20240101000000"
#: Repeated digests up to which they are broadcast (about 60 MB in a task); beyond, it is a shuffled join.
BROADCAST_DIGESTS = 300_000
#: A field of our own in revisits: the page whose record they refer to.
PAGE_FIELD = "X-Refers-To-Page"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes
    offset: int
    first: bool = False


@dataclass
class WarcRecord:
    type: str
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def arc_file(records: list[tuple[dict[str, str], bytes]], version: int, name: str) -> bytes:
    """An ARC file of header fields (URL, Content-type, Archive-date ...) and blocks."""
    about = f"{version} 0 stratagraph\n{FIELDS[version]}\n".encode()
    out = bytearray()
    for fields, block in [({"URL": f"filedesc://{name}", "Content-type": "text/plain"}, about), *records]:
        known = {"IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(len(out)), "Filename": name} | fields | {"Archive-length": str(len(block))}
        out += " ".join(known[f] for f in FIELDS[version].split(" ")).encode() + b"\n" + block + b"\n"
    return bytes(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records; raises ValueError where a header line or a declared length can't be right."""
    at, names, version = 0, FIELDS[1].split(" "), 1
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        values, first = line.split(" "), at == 0
        if first and not line.startswith("filedesc://"):
            raise ValueError("an ARC file begins with a version block")
        if first:  # the version block's own line may have either form
            names = FIELDS[2 if len(values) >= 10 else 1].split(" ")
        if len(values) > len(names):  # a type with blanks
            extra = len(values) - len(names)
            values[3 : 4 + extra] = [" ".join(values[3 : 4 + extra])]
        if end < 0 or len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"bad ARC header line at byte {at}")
        size = int(values[-1])
        if end + 1 + size > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        block = data[end + 1 : end + 1 + size]
        if first:
            said = block.decode("utf-8", "replace").split("\n")
            version = int(said[0].split(" ")[0] or 1)
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} isn't known")
            yield ArcRecord(version, dict(zip(names, values, strict=True)), block, at, True)
            names = (said[1].strip() if len(said) > 1 and said[1].strip() else FIELDS[version]).split(" ")
        else:
            yield ArcRecord(version, dict(zip(names, values, strict=True)), block, at)
        at = end + 1 + size


def _http(block: bytes) -> tuple[bytes, bytes] | None:
    """Header and body, if the block is an HTTP response."""
    if not re.match(rb"HTTP/\d", block):
        return None
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def _http_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}


def _stamp(date: str) -> str:
    date = (date if date.isdigit() else DATE).ljust(14, "0")[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:]}Z"


def _identifier(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


@dataclass(frozen=True)
class Original:
    """The record that a revisit refers to."""

    identifier: str
    url: str
    date: str
    page: str = ""


def convert(record: ArcRecord, name: str, original: Original | None = None, place: str | None = None) -> bytes:
    """A WARC record. original: the response with the same payload, which this then revisits. place: names the record in its identifier."""
    url = record.fields["URL"]
    split = None if record.first else _http(record.block)
    payload = split[1] if split else record.block
    digest = f"sha1:{base32_sha1(payload)}"
    if record.first:
        kind, block, mime = "warcinfo", f"software: stratagraph\r\nformat: WARC File Format 1.1\r\nconverted-from: {name} ARC/{record.version}\r\n".encode(), "application/warc-fields"
    elif original is not None:
        kind, block, mime = "revisit", split[0] if split else b"", "application/http;msgtype=response"
    elif split:
        kind, block, mime = "response", record.block, "application/http;msgtype=response"
    else:
        kind, block, mime = "resource", record.block, record.fields["Content-type"]
    lines = {"WARC-Type": kind, "WARC-Record-ID": _identifier(url, record.fields["Archive-date"], place or f"{name} {record.offset}"), "WARC-Date": _stamp(record.fields["Archive-date"])}
    if record.first:
        lines["WARC-Filename"] = name
    else:
        lines |= {"WARC-Target-URI": url, "WARC-IP-Address": record.fields["IP-address"], "WARC-Payload-Digest": digest}
    if kind == "revisit":
        lines |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": original.identifier, "WARC-Refers-To-Target-URI": original.url, "WARC-Refers-To-Date": _stamp(original.date)}
        if original.page:
            lines[PAGE_FIELD] = original.page
    lines |= {"WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": mime, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def arc_to_warc(data: bytes, name: str, originals: dict[int, Original] | None = None, places: list[str] | None = None) -> Iterator[bytes]:
    """WARC records of an ARC file. originals, places: by a record's number, from 0 after the version block."""
    for i, record in enumerate(parse_arc(data), -1):
        yield convert(record, name, (originals or {}).get(i), places[i] if places and i >= 0 else None)


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The members of a gzip file, one after another, fed in slices: what a member leaves over is less than a slice."""
    view, at = memoryview(data), 0
    while at < len(view):
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("the last gzip member is cut short")
            out.append(unzip.decompress(piece))
            at += len(piece) - len(unzip.unused_data)
        yield b"".join(out)


def parse_warc(data: bytes) -> WarcRecord:
    """One record; block and payload digests are compared with what was read."""
    end = data.find(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = data[end + 4 : end + 4 + int(headers["Content-Length"])]
    if f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"the block of {headers['WARC-Record-ID']} has another digest")
    record = WarcRecord(headers["WARC-Type"], headers, block)
    if split := _http(block):
        record.http, record.payload = _http_fields(split[0]), split[1]
        if record.type == "response" and f"sha1:{base32_sha1(split[1])}" != headers["WARC-Payload-Digest"]:
            raise ValueError(f"the payload of {headers['WARC-Record-ID']} has another digest")
    return record


def base32_column(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: Spark writes numbers of base 32 with 0-9 and A-V."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, first_id, first_url: the smallest page_id with an equal payload of at least min_bytes.

    first_id and first_url are null where no other row has the payload.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.sha1(body).alias("digest"), F.length(body).alias("size"))
    first = own.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f"), F.count("*").alias("n"), F.max("size").alias("size"))
    first = cut(first.filter((F.col("n") > 1) & (F.col("size") >= min_bytes)).select("digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url")))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    return rows.join(F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first, "digest", "left").select("page_id", "url", "payload", "digest", "first_id", "first_url")


def _address(url: str | None) -> str:
    return urllib.parse.quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")


def _place(page: object, digest: str) -> str:
    return f"page {page} {digest}"


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows of with_first() as WARC files by way of ARC; path, records, bytes of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        done, pack, size, records, number = [], [], 0, 0, 0

        def close() -> None:
            nonlocal pack, size, records, number
            if not pack:
                return
            name = f"part-{part:06d}-{number:05d}.warc.gz"
            with files.open_output_stream(f"{root}/.{name}.{attempt}") as out:
                for x in pack:
                    out.write(x)
            files.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
            done.append((f"{folder}/{name}", records, sum(map(len, pack))))
            pack, size, records, number = [], 0, 0, number + 1

        for turn, batch in enumerate(batches):
            legacy, first, places = [], {}, []
            for i, (page, url, payload, digest, first_id, first_url) in enumerate(zip(*(batch.column(k) for k in range(6)), strict=True)):
                page, body, digest, first_id = page.as_py(), payload.as_py(), digest.as_py(), first_id.as_py()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                legacy.append(({"URL": _address(url.as_py())}, head + body))
                places.append(_place(page, digest))
                if first_id is not None and page != first_id:
                    there = _address(first_url.as_py())
                    first[i] = Original(_identifier(there, DATE, _place(first_id, digest)), there, DATE, str(first_id))
            source = f"part-{part:06d}-{turn:06d}.arc"
            for record in arc_to_warc(arc_file(legacy, 1 + part % 2, source), source, first, places):
                pack.append(zlib.compress(record, 1, 31))
                records += 1
                size += len(record)
                if size >= ROTATE:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return rows.select("page_id", "url", "payload", "digest", "first_id", "first_url").transform(in_arrow, run, "path string, records bigint, bytes bigint")


def read_archives(files: DataFrame, kind: T.DataType) -> DataFrame:
    """A row for each page record of WARC files (content binary), as the records themselves say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_date", "record_id", "target_uri")
        for batch in batches:
            out = {n: [] for n in names}
            for content in batch.column(0):
                for record in map(parse_warc, members(content.as_py())):
                    if record.type not in ("response", "revisit"):
                        continue
                    size = len(record.payload) if record.type == "response" else int(record.http["content-length"])
                    refers = record.headers.get(PAGE_FIELD, "")
                    values = (record.http["x-page-id"] or None, size, record.headers["WARC-Payload-Digest"].removeprefix("sha1:"), record.type, refers or None, record.headers["WARC-Date"], record.headers["WARC-Record-ID"], record.headers["WARC-Target-URI"])
                    for n, v in zip(names, values, strict=True):
                        out[n].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.int64() if n == "payload_bytes" else pa.string()) for n in names], names=list(names))

    rows = files.select("content").transform(in_arrow, run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, warc_date string, record_id string, target_uri string")
    return rows.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def pages_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written as WARC files and read back: one row a page."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType
    folder = fresh_dir(spark, "warc")
    made = write_archives(with_first(pages, min_bytes), folder).agg(F.sum("records").alias("n")).first()
    if not made["n"]:
        return spark.createDataFrame([], T.StructType([T.StructField("page_id", kind), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", kind)]))
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder), kind)
