"""Media columns: what bytes are is found from their signatures, whatever type was declared.

One Aho-Corasick automaton holds every magic number; a single walk over the bytes finds all of their places. A magic number
alone proves nothing (a text may hold "BM"), so each hit goes to its format's validator, which follows the structure and
its lengths and says how long the medium is, or that there is none. What stands is carved: type, offset and length, with
a declared type corrected from what lies at offset 0. Media inside other media (a picture in an archive, say) are found
as embedded ones, since the walk covers every byte.

Texts become media as 8-bit mono WAV: one byte a sample, so nothing is lost, and the sample count tells the payload's length.

Defined results: null bytes hold nothing: no row of media, type null. A truncated or inconsistent medium isn't one.
A null or empty text is stored as 64 samples of 0. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common as C
from gleanery.session import staged

RATE = 8000
UNIT = 64
STORED_SCHEMA = "doc_id long, n_bytes long, declared string, media binary"
SNIFFED_SCHEMA = "doc_id long, declared string, type string, corrected boolean, offset long, length long, n_found int"


# Validators: the length of the medium at data[at:], or 0. None raises on any bytes.


def _png(data: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, p)
        if p + 12 + n > len(data) or first and (kind != b"IHDR" or n != 13):
            return 0
        if zlib.crc32(memoryview(data)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", data, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _riff(form: bytes, *needed: tuple[bytes, ...]):
    """A RIFF file of that form whose chunks fill it and hold, of each group of kinds, at least one."""

    def check(data: bytes, at: int) -> int:
        if at + 12 > len(data) or data[at + 8 : at + 12] != form:
            return 0
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        if end > len(data):
            return 0
        p, seen = at + 12, set()
        while p + 8 <= end:
            kind, n = struct.unpack_from("<4sI", data, p)
            if p + 8 + n > end:
                return 0
            seen.add(kind)
            p += 8 + n + n % 2
        return end - at if p in (end, end + 1) and all(seen.intersection(x) for x in needed) else 0

    return check


def _gif(data: bytes, at: int) -> int:
    if at + 13 > len(data):
        return 0
    flags = data[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(data):
            if not data[p]:
                return p + 1
            p += 1 + data[p]
        return len(data) + 1

    images = 0
    while p < len(data):
        if data[p] == 0x3B:
            return p + 1 - at if images else 0
        if data[p] == 0x21:
            p = blocks(p + 2)
        elif data[p] == 0x2C and p + 10 < len(data):
            local = data[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 128 else 0))
            images += 1
        else:
            return 0
    return 0


def _jpeg(data: bytes, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(data) and data[p] == 0xFF:
        kind, n = data[p + 1], struct.unpack_from(">H", data, p + 2)[0]
        if kind < 0xC0 or kind in (0xD8, 0xFF) or n < 2 or p + 2 + n > len(data):
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:
            while 0 <= (p := data.find(b"\xff", p)) < len(data) - 1 and (data[p + 1] == 0 or 0xD0 <= data[p + 1] <= 0xD7):
                p += 2
            if not 0 <= p < len(data) - 1:
                return 0
            if data[p + 1] == 0xD9:
                return p + 2 - at if frame else 0
    return 0


def _bmp(data: bytes, at: int) -> int:
    if at + 54 > len(data):
        return 0
    size, zero, start, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", data, at + 2)
    if zero or header not in (40, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return 0
    need = start + abs(height) * ((width * depth + 31) // 32 * 4)
    return size if 14 + header <= start and need <= size and at + size <= len(data) else 0


def _gzip(data: bytes, at: int) -> int:
    d = zlib.decompressobj(31)
    try:
        rest = memoryview(data)[at:]
        while rest and not d.eof:
            d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail
        return len(data) - at - len(d.unused_data) if d.eof else 0
    except zlib.error:
        return 0


def _zip(data: bytes, at: int) -> int:
    """From a first local header to the end record that points back to it."""
    end = at
    while (end := data.find(b"PK\x05\x06", end + 1)) >= 0 and end + 22 <= len(data):
        size, start, note = struct.unpack_from("<IIH", data, end + 12)
        if start + size == end - at and end + 22 + note <= len(data) and (not size or data[at + start : at + start + 4] == b"PK\x01\x02"):
            return end + 22 + note - at
    return 0


def _pdf(data: bytes, at: int) -> int:
    mark = data.find(b"startxref", at)
    while mark >= 0:
        end = data.find(b"%%EOF", mark)
        if end < 0:
            return 0
        place = data[mark + 9 : end].strip()
        if place.isdigit() and len(place) < 12 and int(place) < mark - at:
            after = data.find(b"startxref", end)
            if after < 0 or data.find(b"%PDF-", end, after) >= 0:
                return end + 5 - at
        mark = data.find(b"startxref", end)
    return 0


#: Each format's magic number, and what confirms it.
FORMATS = {
    "image/png": (b"\x89PNG\r\n\x1a\n", _png),
    "image/gif": (b"GIF8", lambda d, at: _gif(d, at) if d[at + 4 : at + 6] in (b"7a", b"9a") else 0),
    "image/jpeg": (b"\xff\xd8\xff", _jpeg),
    "image/bmp": (b"BM", _bmp),
    "image/webp": (b"RIFF", _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    "audio/wav": (b"RIFF", _riff(b"WAVE", (b"fmt ",), (b"data",))),
    "application/gzip": (b"\x1f\x8b\x08", _gzip),
    "application/zip": (b"PK\x03\x04", _zip),
    "application/pdf": (b"%PDF-", _pdf),
}


def _automaton() -> ahocorasick.Automaton:
    by_magic: dict[bytes, list[str]] = {}
    for kind, (magic, _) in FORMATS.items():
        by_magic.setdefault(magic, []).append(kind)
    found = ahocorasick.Automaton()
    for magic, kinds in by_magic.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kinds))
    found.make_automaton()
    return found


_MAGIC = _automaton()


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every medium in the bytes, embedded ones included, by offset."""
    found = []
    for last, (n, kinds) in _MAGIC.iter(data.decode("latin-1")):
        for kind in kinds:
            if length := FORMATS[kind][1](data, last - n + 1):
                found.append((kind, last - n + 1, length))
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def wav(samples: bytes) -> bytes:
    """8-bit mono samples as a WAV file; an even number of them, as here, needs no padding byte."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + pad


def wav_samples(data: bytes) -> bytes:
    """The samples of 8-bit mono WAV bytes; raises where they are something else."""
    if not _riff(b"WAVE", (b"fmt ",), (b"data",))(data, 0):
        raise ValueError("not a WAV file")
    p, kind_ok = 12, False
    while p + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, p)
        if kind == b"fmt ":
            kind_ok = struct.unpack_from("<HH", data, p + 8) == (1, 1) and struct.unpack_from("<H", data, p + 22)[0] == 8
        elif kind == b"data":
            if not kind_ok:
                raise ValueError("not 8-bit mono")
            return data[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    raise ValueError("no samples")


def payload(text: bytes) -> bytes:
    """The text and bytes 0 up to a positive multiple of UNIT."""
    return text + b"\0" * (-len(text) % UNIT or (0 if text else UNIT))


def stored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text as a medium, declared as arbitrary bytes: what it is, is for the sniffer to say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = C.utf8_of(batch.column(1))
            raw, at = data.tobytes(), at.tolist()
            for lo in range(0, len(at) - 1, 500):
                parts = [raw[a:b] for a, b in zip(at[lo : lo + 500], at[lo + 1 : lo + 501], strict=False)]
                media = pa.array([wav(payload(x)) for x in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(parts)), pa.array([len(x) for x in parts], pa.int64()), pa.array(["application/octet-stream"] * len(parts)), media], names=["doc_id", "n_bytes", "declared", "media"])

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, STORED_SCHEMA)


def sniffed(media: DataFrame, id_column: str = "doc_id", declared: str = "declared", content: str = "media") -> DataFrame:
    """One row for each medium found in `content` (offset 0 is the row's own, others are embedded), or one with type null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, said, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = sniff(data) if data else []
                own = next((x[0] for x in found if not x[1]), None)
                fixed = own if own is not None else said
                for kind, at, n in found or [(None, None, None)]:
                    rows.append((i, said, kind, None if at else fixed != said, at, n, len(found)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "declared", "type", "corrected", "offset", "length", "n_found"])

    return media.select(F.col(id_column).cast("long"), F.col(declared), F.col(content)).mapInArrow(run, SNIFFED_SCHEMA)


def features(samples: bytes) -> str:
    """Integers of the signal: samples, sum, sum of squares, crossings of 128, largest step, in a fixed order."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    above = x >= 128
    step = int(np.abs(np.diff(x)).max()) if len(x) > 1 else 0
    return f"wav8:n={len(x)};sum={int(x.sum())};sq={int((x * x).sum())};cross={int((above[1:] != above[:-1]).sum())};step={step}"


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, n_media int"


def read_back(media: DataFrame) -> DataFrame:
    """Sniffs and carves each stored medium, decodes what was carved and describes payload and medium."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, data in zip(batch.column(1).to_pylist(), (x.as_py() for x in batch.column(3)), strict=True):
                found = sniff(data)
                kind, at, size = found[0]
                own = data[at : at + size]
                samples = wav_samples(own)
                rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(own), hashlib.sha256(own).hexdigest(), features(samples), kind, len(found)))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32())
            names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return media.mapInArrow(run, DIGEST_SCHEMA)


def round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Texts stored as media in the shared folder, and what is read back from there."""
    return read_back(staged(stored(docs, id_column, text_column), "media"))


def carved(media: DataFrame, found: DataFrame, id_column: str = "doc_id", content: str = "media") -> DataFrame:
    """The bytes of every medium that sniffed() found: id, type, offset, bytes."""
    own = media.select(F.col(id_column).alias("doc_id"), F.col(content).alias("content"))
    hits = found.where("type is not null").select("doc_id", "type", "offset", "length")
    return hits.join(own, "doc_id").select("doc_id", "type", "offset", F.expr("substring(content, cast(offset + 1 as int), cast(length as int))").alias("bytes"))
