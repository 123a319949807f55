"""Media columns: signature sniffing, type correction and carving of embedded media.

An Aho-Corasick automaton finds all magic bytes, and marks that end a format, in one pass over a value. A validator for each
format then confirms the structure from there on and gives the end of the medium, or refuses. The
medium that starts at byte 0 corrects a declared type; others are carved.

Payloads are stored losslessly as 8-bit grey PNG images of 64 samples a row.

Defined results: a null value counts as empty; an empty payload becomes 64 zero bytes; a value with
no valid medium at 0 keeps the type application/octet-stream; media inside a confirmed medium
are not carved again; extra columns are not read; repeated rows give repeated answers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.common import prepare, settle

UNIT = 64
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
UNKNOWN = "application/octet-stream"
#: What ends a zip archive and a PDF document, and what comes before a document's end.
ZIP_END, PDF_END, PDF_START = b"PK\x05\x06", b"%%EOF", b"startxref"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of UNIT."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0")


def to_png(payload: bytes) -> bytes:
    """The payload's bytes as samples of an 8-bit grey image, UNIT samples a row."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Samples of an image that to_png wrote (8-bit grey, filter type 0)."""
    at, body, size = len(PNG_MAGIC), [], None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if size is None or size[2:4] != (8, 0):
        raise ValueError("not an 8-bit grey image")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a line's filter is not 0")
    return lines[:, 1:]


class Tails:
    """Where a value holds the marks that end a format, found in the same pass as the magic bytes.

    A validator that looked for its end by itself would read the rest of the value again for each magic.
    """

    def __init__(self, data: bytes, marks: dict[bytes, list[int]]):
        self.marks = marks
        #: End of a zip archive by where the archive starts, as each end record tells it.
        self.zips: dict[int, int] = {}
        for at in marks.get(ZIP_END, ()):
            if at + 22 <= len(data):
                n, size, start, comment = struct.unpack_from("<HIIH", data, at + 10)
                first = at - size - start
                if first >= 0 and (not n or data[first + start : first + start + 4] == b"PK\x01\x02") and at + 22 + comment <= len(data):
                    self.zips.setdefault(first, at + 22 + comment)

    def after(self, mark: bytes, at: int) -> int | None:
        """The first place of a mark from there on."""
        places = self.marks.get(mark, ())
        i = bisect_left(places, at)
        return places[i] if i < len(places) else None


def _png(d: bytes, p: int, tails: Tails) -> int | None:
    at, kinds = p + 8, []
    while at + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        end = at + 12 + n
        if end > len(d) or (not kinds) != (kind == b"IHDR") or not kind.isalpha():
            return None
        if kind == b"IHDR":
            width, height, bits, colour, packing, filtering, lacing = struct.unpack_from(">IIBBBBB", d, at + 8) if n == 13 else (0,) * 7
            if not width or not height or bits not in (1, 2, 4, 8, 16) or colour not in (0, 2, 3, 4, 6) or packing or filtering or lacing > 1:
                return None
        if zlib.crc32(memoryview(d)[at + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end if b"IDAT" in kinds and n == 0 else None
        at = end
        kinds.append(kind)
    return None


def _jpeg(d: bytes, p: int, tails: Tails) -> int | None:
    at, scans = p + 2, 0
    while at + 4 <= len(d) and d[at] == 0xFF:
        mark = d[at + 1]
        if mark == 0xD9:
            return at + 2 if scans else None
        if mark == 0xFF:
            at += 1
            continue
        n = struct.unpack_from(">H", d, at + 2)[0]
        if n < 2 or mark in (0x00, 0xD8):
            return None
        at += 2 + n
        if mark == 0xDA:
            scans += 1
            while True:
                at = d.find(b"\xff", at)
                if at < 0 or at + 1 >= len(d):
                    return None
                if d[at + 1] == 0 or 0xD0 <= d[at + 1] <= 0xD7:
                    at += 2
                else:
                    break
    return at + 2 if scans and d[at : at + 2] == b"\xff\xd9" else None


def _gif(d: bytes, p: int, tails: Tails) -> int | None:
    if p + 13 > len(d):
        return None
    at, images = p + 13 + (3 << ((d[p + 10] & 7) + 1) if d[p + 10] & 0x80 else 0), 0
    while at < len(d):
        mark = d[at]
        if mark == 0x3B:
            return at + 1 if images else None
        if mark == 0x21:
            at += 2
        elif mark == 0x2C and at + 10 <= len(d):
            flags = d[at + 9]
            at += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
            images += 1
        else:
            return None
        while at < len(d) and d[at]:
            at += 1 + d[at]
        at += 1
    return None


def _bmp(d: bytes, p: int, tails: Tails) -> int | None:
    if p + 30 > len(d):
        return None
    size, zero, start, header = struct.unpack_from("<IIII", d, p + 2)
    planes, bits = struct.unpack_from("<HH", d, p + 26)
    good = zero == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= start <= size
    return p + size if good and p + size <= len(d) else None


def _riff(kind: bytes, first: tuple[bytes, ...], needs: bytes | None = None) -> Callable[[bytes, int, Tails], int | None]:
    def check(d: bytes, p: int, tails: Tails) -> int | None:
        if p + 20 > len(d) or d[p + 8 : p + 12] != kind or d[p + 12 : p + 16] not in first:
            return None
        end, at, met = p + 8 + struct.unpack_from("<I", d, p + 4)[0], p + 12, needs is None
        while end <= len(d) and at + 8 <= end:
            part, n = struct.unpack_from("<4sI", d, at)
            met, at = met or part == needs, at + 8 + n + (n & 1)
        return end if end <= len(d) and met and end <= at <= end + 1 else None

    return check


def _crc_table(bits: int, polynomial: int) -> list[int]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ (polynomial if crc & top else 0)) & mask
        out.append(crc)
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _flac_header(d: bytes, at: int) -> tuple[int, int] | None:
    """Samples and header length of the FLAC frame at a place, if one starts there."""
    if at + 6 > len(d) or d[at] != 0xFF or d[at + 1] & 0xFE != 0xF8:
        return None
    size, rate, channels, depth = d[at + 2] >> 4, d[at + 2] & 15, d[at + 3] >> 4, d[at + 3] & 15
    if size == 0 or rate == 15 or channels > 10 or depth & 1 or depth == 6:
        return None
    lead = d[at + 4]  # a number coded like a character in UTF-8
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if lead >= 0x80 and more < 1:
        return None
    end = at + 5 + more
    if size == 1:
        samples = 192
    elif size <= 5:
        samples = 576 << (size - 2)
    elif size <= 7:
        samples = int.from_bytes(d[end : end + size - 5], "big") + 1
        end += size - 5
    else:
        samples = 256 << (size - 8)
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(d):
        return None
    crc = 0
    for byte in d[at:end]:
        crc = _CRC8[crc ^ byte]
    return (samples, end + 1 - at) if crc == d[end] else None


def _flac(d: bytes, p: int, tails: Tails) -> int | None:
    """Frames run until the stream's samples are all there; a frame ends where its CRC-16 comes out as zero."""
    at, first = p + 4, True
    while at + 4 <= len(d):
        kind, n = d[at] & 0x7F, int.from_bytes(d[at + 1 : at + 4], "big")
        if first and ((kind, n) != (0, 34) or at + 38 > len(d)):
            return None
        if first:
            longest, total = int.from_bytes(d[at + 11 : at + 14], "big") or 1 << 24, int.from_bytes(d[at + 17 : at + 22], "big") & 0xFFFFFFFFF
        last, at, first = d[at] & 0x80, at + 4 + n, False
        if last:
            break
    else:
        return None
    done = 0
    while (head := _flac_header(d, at)) is not None:
        crc, end = 0, None
        for i in range(at, min(len(d), at + longest)):
            crc = ((crc << 8) & 0xFFFF) ^ _CRC16[(crc >> 8) ^ d[i]]
            if crc == 0 and i >= at + head[1] + 1 and (done + head[0] >= total or _flac_header(d, i + 1) is not None):
                end = i + 1
                break
        if end is None:
            return None
        done, at = done + head[0], end
        if done >= total:
            return at
    return None


def _ogg(d: bytes, p: int, tails: Tails) -> int | None:
    at, pages = p, 0
    while d[at : at + 5] == b"OggS\0" and at + 27 <= len(d):
        n = d[at + 26]
        end = at + 27 + n + sum(d[at + 27 : at + 27 + n])
        if end > len(d):
            return None
        pages, last, at = pages + 1, d[at + 5] & 4, end
        if last:
            return at
    return None


def _pdf(d: bytes, p: int, tails: Tails) -> int | None:
    if not (d[p + 5 : p + 6].isdigit() and d[p + 6 : p + 7] == b"."):
        return None
    end, start = tails.after(PDF_END, p), tails.after(PDF_START, p)
    return end + len(PDF_END) if end is not None and start is not None and start < end else None


def _gzip(d: bytes, p: int, tails: Tails) -> int | None:
    if p + 18 > len(d) or d[p + 2] != 8 or d[p + 3] & 0xE0:
        return None
    engine, at = zlib.decompressobj(31), p
    try:
        while not engine.eof:
            if at >= len(d) and not engine.unconsumed_tail:
                return None
            block = engine.unconsumed_tail or d[at : at + (1 << 16)]
            at += 0 if engine.unconsumed_tail else len(block)
            engine.decompress(block, 1 << 20)
    except zlib.error:
        return None
    return at - len(engine.unused_data)


def _zip(d: bytes, p: int, tails: Tails) -> int | None:
    return tails.zips.get(p)


#: Kinds of a file's outermost boxes.
BOXES = (b"ftyp", b"styp", b"moov", b"moof", b"mfra", b"mdat", b"meta", b"free", b"skip", b"wide", b"sidx", b"pdin", b"uuid")


def _mp4(d: bytes, p: int, tails: Tails) -> int | None:
    """Boxes in a row, to the first thing that is none; a box that is cut off spoils the file."""
    at, kinds = p - 4, []
    while at + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        if kind not in BOXES:
            break
        if n == 1 and at + 16 <= len(d):
            n = struct.unpack_from(">Q", d, at + 8)[0]
        if n < 8 or at + n > len(d):
            return None
        kinds.append(kind)
        at += n
    return at if kinds[:1] == [b"ftyp"] and b"moov" in kinds else None


#: Magic bytes, media type, distance from the medium's start to the magic.
FORMATS: list[tuple[bytes, str, int, Callable[[bytes, int, Tails], int | None]]] = [
    (PNG_MAGIC, "image/png", 0, _png),
    (b"\xff\xd8\xff", "image/jpeg", 0, _jpeg),
    (b"GIF87a", "image/gif", 0, _gif),
    (b"GIF89a", "image/gif", 0, _gif),
    (b"BM", "image/bmp", 0, _bmp),
    (b"RIFF", "audio/wav", 0, _riff(b"WAVE", (b"fmt ", b"JUNK", b"bext"), b"data")),
    (b"RIFF", "image/webp", 0, _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    (b"fLaC", "audio/flac", 0, _flac),
    (b"OggS", "audio/ogg", 0, _ogg),
    (b"%PDF-", "application/pdf", 0, _pdf),
    (b"\x1f\x8b", "application/gzip", 0, _gzip),
    (b"PK\x03\x04", "application/zip", 0, _zip),
    (b"ftyp", "video/mp4", 4, _mp4),
]
_MARKS: dict[bytes, list[int]] = {mark: [] for mark in (ZIP_END, PDF_END, PDF_START)}
for _i, (_magic, *_rest) in enumerate(FORMATS):
    _MARKS.setdefault(_magic, []).append(_i)
_AUTOMATON = ahocorasick.Automaton()
for _magic, _which in _MARKS.items():
    _AUTOMATON.add_word(_magic.decode("latin-1"), (_magic, tuple(_which)))
_AUTOMATON.make_automaton()


def media_in(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of every confirmed medium that is not inside another, by start."""
    hits: list[tuple[int, int]] = []
    marks: dict[bytes, list[int]] = {}
    for last, (magic, which) in _AUTOMATON.iter(data.decode("latin-1")):
        at = last + 1 - len(magic)
        if which:
            hits += [(at - FORMATS[i][2], i) for i in which]
        else:
            marks.setdefault(magic, []).append(at)
    if not hits:
        return []
    tails, found, covered = Tails(data, marks), [], 0
    for start, i in sorted(hits):
        if start < covered or start < 0:
            continue
        _, kind, shift, check = FORMATS[i]
        if (end := check(data, start + shift, tails)) is not None:
            found.append((start, end, kind))
            covered = end
    return found


def sniff(df: DataFrame, *, id_col: str, content_col: str, declared_col: str | None = None) -> DataFrame:
    """Rows (id, declared, media_type, n_bytes, carved): the type found at byte 0 and other media inside.

    carved is an array of (start, length, media_type, sha256). A map, no shuffle.
    """
    prepare(df.sparkSession, 256)
    declared = F.col(declared_col) if declared_col else F.lit(None)
    slim = df.select(F.col(id_col).alias("id"), declared.cast("string").alias("declared"), F.coalesce(F.col(content_col), F.lit(b"")).alias("content"))
    kind = slim.schema["id"].dataType.simpleString()
    inner = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("media_type", pa.string()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, sizes, carved = [], [], []
            for data in batch.column(2).to_pylist():
                media = media_in(data)
                types.append(media[0][2] if media and media[0][0] == 0 else UNKNOWN)
                sizes.append(len(data))
                carved.append([{"start": a, "length": b - a, "media_type": t, "sha256": hashlib.sha256(data[a:b]).hexdigest()} for a, b, t in media if a])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(types, pa.string()), pa.array(sizes, pa.int64()), pa.array(carved, pa.list_(inner))], ["id", "declared", "media_type", "n_bytes", "carved"])

    return slim.mapInArrow(run, f"id {kind}, declared string, media_type string, n_bytes long, carved array<struct<start:long,length:long,media_type:string,sha256:string>>")


def store_payloads(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's padded UTF-8 bytes as an image, in a table in the shared folder: doc_id, n_bytes, declared, media."""
    prepare(docs.sparkSession, 256)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, data), pa.int64()), pa.array([UNKNOWN] * len(data)), pa.array((to_png(pad(d)) for d in data), pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return settle(slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, declared string, media binary"), "media")


def features(stored: DataFrame) -> DataFrame:
    """Read stored media back: sniff, correct the declared type, decode, and digest payload and medium.

    feature ends with the number of media inside the payload (less its padding), and type@start+length of each.
    """
    prepare(stored.sparkSession, 256)
    slim = stored.select("doc_id", "n_bytes", "declared", "media")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            out = []
            for n, declared, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                media = media_in(data)
                found = media[0][2] if media and media[0][:2] == (0, len(data)) else UNKNOWN
                if found != "image/png":
                    raise ValueError("a stored image is damaged")
                samples = from_png(data)
                payload = samples.tobytes()
                inside = media_in(payload[:n])
                places = "".join(f" {t}@{a}+{b - a}" for a, b, t in inside)
                text = f"{declared}>{found} {UNIT}x{len(samples)} mean={samples.mean():.4f} distinct={np.count_nonzero(np.bincount(samples.reshape(-1), minlength=256))} embedded={len(inside)}{places}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), text))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
