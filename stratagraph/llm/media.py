"""Media columns: sniffing signatures, validating structures and carving embedded objects.

An Aho-Corasick automaton finds every magic number in a byte column in one pass. A format's validator
then walks the structure from there (chunks with checksums, declared lengths, trailers) and says how
long the object is, or that it is none. An object at offset 0 that fills the column corrects a wrong
declared type; valid objects elsewhere are carved, the outermost of nested ones first.

The samples operator stores bytes losslessly as an 8-bit grey PNG, 64 samples a row, under a declared
type that says nothing, and reads them back through sniffing and carving: the stored object must be the one that the
validator finds at 0, with as many rows as its structure says; the samples are then sniffed in turn, so that media
inside a payload are carved. The feature tells what was found: the type and its correction, the chunks that were
walked, the objects carved from the payload, and whole-number statistics of the samples.

Null and empty payloads are one row of zeros. Equal bytes, as in repeated rows, give equal stored forms; nothing depends
on other rows. Very long payloads are stored and read whole; validators walk them in place, without copies of what
follows a hit. Null content is no object and keeps its declared type, also a null one. Other columns, whatever their
names, aren't read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

WIDTH = 64
#: Fixed values of the formats: magic numbers, and the types they stand for.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b"PK\x03\x04": "application/zip",
    b"%PDF-": "application/pdf",
    b"fLaC": "audio/flac",
}


def _png(data: memoryview, at: int) -> int:
    """The chunks' lengths and checksums up to IEND."""
    place, first = at + 8, True
    while place + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, place)
        kind = bytes(data[place + 4 : place + 8])
        if place + 12 + size > len(data) or first != (kind == b"IHDR") or first and size != 13:
            return 0
        if zlib.crc32(data[place + 4 : place + 8 + size]) != struct.unpack_from(">I", data, place + 8 + size)[0]:
            return 0
        place, first = place + 12 + size, False
        if kind == b"IEND":
            return place - at
    return 0


def _gif(data: memoryview, at: int) -> int:
    if at + 13 > len(data):
        return 0
    place = at + 13 + (3 << ((data[at + 10] & 7) + 1) if data[at + 10] & 0x80 else 0)

    def blocks(place: int) -> int:
        while place < len(data) and data[place]:
            place += 1 + data[place]
        return place + 1

    while place < len(data):
        if data[place] == 0x3B:
            return place + 1 - at
        if data[place] == 0x21:
            place = blocks(place + 2)
        elif data[place] == 0x2C and place + 10 <= len(data):
            flags = data[place + 9]
            place = blocks(place + 10 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0) + 1)
        else:
            return 0
    return 0


def _jpeg(data: memoryview, at: int) -> int:
    """Segments up to the scan, then the end marker outside stuffed bytes and restarts."""
    place, frame = at + 2, False
    while place + 4 <= len(data) and data[place] == 0xFF:
        kind = data[place + 1]
        if kind == 0xFF:
            place += 1
            continue
        if kind < 0xC0 or kind in (0xD8, 0xD9):
            return 0
        (size,) = struct.unpack_from(">H", data, place + 2)
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        place += 2 + size
        if size < 2 or place > len(data):
            return 0
        if kind != 0xDA:
            continue
        mark = _MARKER.search(data, place)
        if not mark:
            return 0
        place = mark.start()
        if data[place + 1] == 0xD9:
            return place + 2 - at if frame else 0
    return 0


def _bmp(data: memoryview, at: int) -> int:
    if at + 54 > len(data):
        return 0
    size, _, start, head = struct.unpack_from("<IIII", data, at + 2)
    ok = head in (40, 52, 56, 108, 124) and 14 + head <= start <= size <= len(data) - at
    planes, bits = struct.unpack_from("<HH", data, at + 26)
    return size if ok and planes == 1 and bits in (1, 4, 8, 16, 24, 32) else 0


def _riff(data: memoryview, at: int) -> int:
    """WAVE and WEBP, with whole chunks that fill the declared length."""
    if at + 12 > len(data) or bytes(data[at + 8 : at + 12]) not in (b"WAVE", b"WEBP"):
        return 0
    (size,) = struct.unpack_from("<I", data, at + 4)
    end, place = at + 8 + size, at + 12
    if end > len(data):
        return 0
    while place + 8 <= end:
        place += 8 + (struct.unpack_from("<I", data, place + 4)[0] + 1) // 2 * 2
    return end - at if place in (end, end + 1) and size > 4 else 0


def _zip(data: memoryview, at: int) -> int:
    """Up to an end record whose directory lies within and starts with an entry."""
    for mark in _ZIP_END.finditer(data, at):
        end = mark.start() - at
        if mark.start() + 22 > len(data):
            break
        size, start, note = struct.unpack_from("<IIH", data, mark.start() + 12)
        if start + size == end and data[at + start : at + start + 4] == b"PK\x01\x02" and mark.start() + 22 + note <= len(data):
            return end + 22 + note
    return 0


def _pdf(data: memoryview, at: int) -> int:
    """Up to the end mark of the last revision whose cross-reference offset holds from here.

    A revision's table lies behind the one before; a linearized file's first offset is 0. Where no offset holds, the
    last end mark before the next header counts.
    """
    end = 0
    for m in _XREF.finditer(data, at):
        place = int(m[1])
        if place >= max(end, 1) and place < m.start() - at and _TABLE.match(data, at + place):
            end = m.end() - at
    if not end:
        header = _PDF_HEAD.search(data, at + 5)
        stop, begun, last = header.start() if header else len(data), _PDF_XREF.search(data, at), 0
        for m in _PDF_END.finditer(data, begun.end(), stop) if begun else ():
            last = m.end()
        end = last - at if last else 0
    return end


def _table(poly: int, bits: int) -> list[int]:
    top, out = 1 << bits - 1, []
    for i in range(256):
        c = i << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & (1 << bits) - 1
        out.append(c)
    return out


_MARKER = re.compile(rb"\xff(?![\x00\xd0-\xd7\xff])(?=[\x00-\xff])", re.DOTALL)
_ZIP_END, _PDF_HEAD, _PDF_XREF, _PDF_END = (re.compile(x) for x in (rb"PK\x05\x06", rb"%PDF-", rb"startxref", rb"%%EOF"))
_XREF = re.compile(rb"startxref\s+(\d{1,12})\s+%%EOF")
_TABLE = re.compile(rb"\s{0,2}(?:xref|\d+\s+\d+\s+obj)\b")
_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _frame_head(data: memoryview, at: int) -> bool:
    """Whether a FLAC frame's header with its checksum stands here."""
    head = bytes(data[at : at + 17])
    if len(head) < 6 or head[0] != 0xFF or head[1] >> 1 != 0x7C:
        return False
    size, rate = head[2] >> 4, head[2] & 15
    if not size or rate == 15 or head[3] >> 4 > 10 or head[3] >> 1 & 7 == 3 or head[3] & 1:
        return False
    number = next((n for n in range(8) if not head[4] >> 7 - n & 1), 8)  # leading ones of the coded number
    if number in (1, 8):
        return False
    end = 4 + max(number, 1) + {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for b in head[:end]:
        crc = _CRC8[crc ^ b]
    return end < len(head) and crc == head[end]


def _frame(data: memoryview, at: int, most: int) -> int:
    """The end of the frame: where its checksum holds and another frame, an object or the end follows, else where it holds first."""
    crc, first = 0, 0
    for place in range(at, min(len(data), at + most)):
        crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ data[place]]
        if not crc and place - at >= 8:
            end = place + 1
            if end == len(data) or _frame_head(data, end) or bytes(data[end : end + 8]).startswith(tuple(MAGIC)):
                return end
            first = first or end
    return first


def _flac(data: memoryview, at: int) -> int:
    """Metadata blocks, then frames as long as their checksums hold. A broken first frame runs to the next valid object."""
    place = at + 4
    while place + 4 <= len(data):
        (head,) = struct.unpack_from(">I", data, place)
        kind, size = head >> 24 & 0x7F, head & 0xFFFFFF
        if place == at + 4 and ((kind, size) != (0, 34) or place + 38 > len(data)):
            return 0
        place += 4 + size
        if head >> 31:
            break
    else:
        return 0
    if place + 2 > len(data) or data[place] != 0xFF or data[place + 1] >> 2 != 0x3E:
        return 0
    info = bytes(data[at + 8 : at + 42])
    block, longest = int.from_bytes(info[2:4]), int.from_bytes(info[7:10])
    channels, bits = (info[12] >> 1 & 7) + 1, ((info[12] & 1) << 4 | info[13] >> 4) + 1
    most, begin = longest or (block or 65535) * channels * (bits + 1) // 8 + 64 + 8 * channels, place
    while _frame_head(data, place) and (end := _frame(data, place, most)):
        place = end
    if place == begin:
        return next((n for n, _, _ in objects(bytes(data[begin:]))), len(data) - begin) + begin - at
    return place - at


VALIDATORS = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "riff": _riff, "application/zip": _zip, "application/pdf": _pdf, "audio/flac": _flac}
_AUTOMATA: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    if not _AUTOMATA:
        made = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            made.add_word(magic.decode("latin-1"), (kind, len(magic)))
        made.make_automaton()
        _AUTOMATA.append(made)
    return _AUTOMATA[0]


def objects(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(offset, length, type) of valid objects that don't lie in an earlier one, by offset."""
    view, end, hits = memoryview(data), 0, []
    for last, (kind, size) in _automaton().iter(data.decode("latin-1")):
        hits.append((last + 1 - size, kind))
    for at, kind in sorted(hits):
        if at >= end and (length := VALIDATORS[kind](view, at)):
            end = at + length
            name = {b"WAVE": "audio/wav", b"WEBP": "image/webp"}[data[at + 8 : at + 12]] if kind == "riff" else kind
            yield at, length, name


def sniff(data: bytes | None, declared: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The corrected type, and the embedded objects. Without a valid object at 0 the declared type stays."""
    found = list(objects(data or b""))
    if found and found[0][0] == 0:
        return found[0][2], found[1:]
    return declared, found


def sniffed(df: DataFrame, content: str, declared: str, keys: list[str]) -> DataFrame:
    """keys, declared_type, media_type, corrected, embedded array<struct<offset,length,type>>."""

    def run(batch: pa.RecordBatch) -> dict:
        out = {k: batch.column(i) for i, k in enumerate(keys)} | {"declared_type": batch.column(len(keys)), "media_type": [], "corrected": [], "embedded": []}
        for data, said in zip(batch.column(len(keys) + 1), out["declared_type"].to_pylist(), strict=True):
            kind, inner = sniff(data.as_py(), said)
            out["media_type"].append(kind)
            out["corrected"].append(kind != said)
            out["embedded"].append([{"offset": a, "length": n, "type": t} for a, n, t in inner])
        return out

    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{head}, declared_type string, media_type string, corrected boolean, embedded array<struct<offset:bigint,length:bigint,type:string>>"
    return by_batch(df.select(*keys, F.col(declared).cast("string"), F.col(content).cast("binary")), run, schema)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def store(payload: bytes) -> bytes:
    """A grey PNG of the payload, whose length is a positive multiple of WIDTH."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of a PNG's chunks, whose checksums have been compared before."""
    place = 8
    while place < len(media):
        (size,) = struct.unpack_from(">I", media, place)
        yield media[place + 4 : place + 8], media[place + 8 : place + 8 + size]
        place += 12 + size


def samples(media: bytes) -> np.ndarray:
    """The grey samples of a PNG that store() can have made, by row."""
    found = list(chunks(media))
    width, rows, bits, colour, *_ = struct.unpack(">IIBBBBB", found[0][1])
    lines = np.frombuffer(zlib.decompress(b"".join(data for kind, data in found if kind == b"IDAT")), np.uint8).reshape(rows, width + 1)
    if (bits, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("only unfiltered grey samples of 8 bits are read")
    return lines[:, 1:]


def feature(media: bytes, kind: str, corrected: bool, grey: np.ndarray, inner: list[tuple[int, int, str]]) -> str:
    """The structure that was found, and size, range, sum, ink and roughness of the samples, in whole numbers."""
    x = grey.reshape(-1).astype(np.int32)
    walked = "+".join(f"{name.decode('latin-1')}:{len(data)}" for name, data in chunks(media))
    carved = ",".join(f"{t}@{a}+{n}" for a, n, t in inner)
    rough, ink = int(np.abs(np.diff(x)).sum()), int(np.count_nonzero(x))
    return f"{kind};corrected={int(corrected)};chunks={walked};carved={len(inner)}[{carved}];{grey.shape[1]}x{grey.shape[0]};max={int(x.max())};sum={int(x.sum(dtype=np.int64))};ink={ink};rough={rough}"


def stored_samples(docs: DataFrame, key: str = "doc_id", text: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """key, media (the stored form), declared_type, n_bytes: each text's padded bytes as an image."""

    def run(batch: pa.RecordBatch) -> dict:
        out = {"key": batch.column(0), "media": [], "declared_type": [declared] * batch.num_rows, "n_bytes": []}
        for value in batch.column(1):
            raw = (value.as_py() or "").encode()
            out["media"].append(store(raw + bytes(WIDTH * max(1, -(-len(raw) // WIDTH)) - len(raw))))
            out["n_bytes"].append(len(raw))
        return out

    kind = docs.schema[key].dataType.simpleString()
    made = by_batch(docs.select(F.col(key).alias("key"), F.col(text).cast("string")), run, f"key {kind}, media binary, declared_type string, n_bytes bigint")
    return made.withColumnRenamed("key", key)


def read_samples(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sniffs, carves and reads stored media: sizes, digests and a feature of what was read back."""

    def run(batch: pa.RecordBatch) -> dict:
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type")
        out = {"key": batch.column(0), "n_bytes": batch.column(3)} | {n: [] for n in names}
        for data, said in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            media = data.as_py()
            whole = next(objects(media), (0, 0, ""))
            if whole != (0, len(media), "image/png"):
                raise ValueError("the stored form isn't one whole image")
            grey = samples(media)
            payload = grey.tobytes()
            inner = list(objects(payload))
            values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(media, whole[2], whole[2] != said, grey, inner), whole[2])
            for n, v in zip(names, values, strict=True):
                out[n].append(v)
        return out

    kind = stored.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media_type string"
    return by_batch(stored.select(F.col(key).alias("key"), "media", "declared_type", "n_bytes"), run, schema).withColumnRenamed("key", key)
