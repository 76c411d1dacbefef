"""WARC archives in Zstandard: a writer with repeated payloads as revisits, and a reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary all its frames were compressed with, and
then has one frame for each record, so a reader can start at any frame. The reader loads the dictionary, walks the frames by
their block headers, decodes each alone and checks the version line, the headers, Content-Length against what is there, the
closing blank lines and, for payloads that are present, the digest. A record that fails a check comes out as a row with
an error and the others still come out; what can't be walked any further is one last row with an error.

Archives are rows (archive_id, content) of some MB, as Spark's binaryFile reader gives them for files; they are stored in the
folder that executors share. The dictionary is trained on a bounded sample of pages (SAMPLE_PAGES, SAMPLE_CHARS of each).

Defined results: a null html has an empty payload. A null page_id is no group's smallest; a group of null ids alone has only
responses. Rows that repeat a group's smallest page_id are all responses. A null url leaves the target out. Extra columns
are ignored. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common as C
from gleanery.session import staged

SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 8192, 32768
ARCHIVE_BYTES = 4 << 20
LEAST_SHARED = 100
DATE = "2026-01-01T00:00:00Z"
ARCHIVE_SCHEMA = "archive_id long, n_records long, content binary"
RECORD_SCHEMA = "archive_id long, at long, record_type string, page_id long, target string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def trained_dictionary(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> bytes:
    """A dictionary from pages chosen by a hash of their ids; empty where there is too little to learn from."""
    rows = pages.select(F.col(id_column).cast("long").alias("i"), F.substring(F.col(html_column), 1, SAMPLE_CHARS).alias("t")).where("i is not null and t <> ''")
    chosen = rows.select("i").distinct().orderBy(F.xxhash64("i"), "i").limit(SAMPLE_PAGES)
    rows = rows.join(F.broadcast(chosen), "i").groupBy("i").agg(F.min("t").alias("t")).orderBy("i").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.t.encode() for r in rows]).as_bytes() if len(rows) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:gleanery:page:{'' if page_id is None else page_id}:{digest[:32]}>"


def _page_of(urn: str) -> int | None:
    number = urn.strip("<>").split(":")[3]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, first: int | None) -> bytes:
    """One record's bytes; first is the response's page_id for a revisit, whose payload is left out."""
    target = "" if url is None else "WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) + "\r\n"
    refers = "" if first is None else f"WARC-Refers-To: {_urn(first, digest)}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = (
        f"WARC/1.1\r\nWARC-Type: {'response' if first is None else 'revisit'}\r\nWARC-Record-ID: {_urn(page_id, digest)}\r\nWARC-Date: {DATE}\r\n{target}{refers}"
        f"WARC-Payload-Digest: sha256:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def opening(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""


def archives(pages: DataFrame, dictionary: bytes, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """All pages as archives of about ARCHIVE_BYTES. Only payloads that stand more than once are looked up in a join."""
    html = F.coalesce(F.col(html_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.unhex(F.sha2("payload", 256))})
    shared = rows.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # written, so that its measured size decides whether it is broadcast or payloads must be shuffled
    known = C.joined_spreading(rows, staged(shared, "shared"), "digest", how="left")
    is_revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    laid = known.select("page_id", "url", F.when(~is_revisit, F.col("payload")).alias("payload"), "size", F.lower(F.hex("digest")).alias("digest"), F.when(is_revisit, F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _compressor(dictionary)
        start = opening(dictionary)
        part, number, parts, size = TaskContext.get().partitionId(), 0, [start], 0

        def row():
            nonlocal number, parts, size
            out = pa.RecordBatch.from_pydict({"archive_id": [(part << 33) + number], "n_records": [len(parts) - 1], "content": pa.array([b"".join(parts)], pa.binary())})
            number, parts, size = number + 1, [start], 0
            return out

        for batch in batches:
            for values in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                parts.append(press.compress(record(*values)))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield row()
        if len(parts) > 1:
            yield row()

    return laid.mapInArrow(run, ARCHIVE_SCHEMA)


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at `at` ends, from its headers; raises ValueError where they don't fit the bytes."""
    try:
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == FRAME:
            descriptor = data[at + 4]
            single = descriptor >> 5 & 1
            p = at + 5 + (1 - single) + (0, 1, 2, 4)[descriptor & 3] + ((1 if single else 0), 2, 4, 8)[descriptor >> 6]
            last = 0
            while not last:
                head = int.from_bytes(data[p : p + 3], "little")
                if p + 3 > len(data):
                    raise ValueError("a block header is cut off")
                last, kind, size = head & 1, head >> 1 & 3, head >> 3
                if kind == 3:
                    raise ValueError("a reserved block type")
                p += 3 + (1 if kind == 1 else size)
            end = p + 4 * (descriptor >> 2 & 1)
        else:
            raise ValueError("not a frame")
    except (struct.error, IndexError) as e:
        raise ValueError("a frame header is cut off") from e
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def loaded_dictionary(data: bytes) -> tuple[bytes, int]:
    """The dictionary of the leading skippable frame (itself perhaps compressed) and where records start."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return b"", 0
    end = frame_end(data, 0)
    inner = data[8:end]
    if inner[:4] == struct.pack("<I", FRAME):
        inner = zstandard.ZstdDecompressor().decompressobj().decompress(inner)
    if inner[:4] != struct.pack("<I", DICTIONARY):
        raise ValueError("the leading frame holds no dictionary")
    return inner, end


def parsed(raw: bytes) -> dict:
    """The fields of a decoded record; raises ValueError for what doesn't hold."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not blank or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError("a header line without a name")
        fields[name.strip().lower()] = value.strip()
    if missing := [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in fields]:
        raise ValueError(f"no {missing[0]}")
    n = fields["content-length"]
    if not n.isdigit() or int(n) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't fit the block")
    http, blank, payload = rest[:-4].partition(b"\r\n\r\n")
    size = next((x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    if not blank or not size.isdigit():
        raise ValueError("no HTTP headers with a length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != int(size) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload has another length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit with a payload or without its response")
    return {
        "record_type": kind, "page_id": _page_of(fields["warc-record-id"]), "target": fields.get("warc-target-uri"), "payload_bytes": int(size), "payload_digest": digest,
        "refers_to": _page_of(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def records(data: bytes, most: int = 1 << 30) -> Iterator[dict]:
    """Every record of an archive's bytes, as fields with "at" and "error"."""
    at = 0
    try:
        dictionary, at = loaded_dictionary(data)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        while at < len(data):
            end = frame_end(data, at)
            if struct.unpack_from("<I", data, at)[0] == FRAME:
                try:
                    yield {"at": at, **parsed(reader.decompress(data[at:end], max_output_size=most))}
                except (ValueError, IndexError, zstandard.ZstdError) as e:
                    yield {"at": at, "error": str(e)}
            at = end
    except (ValueError, zstandard.ZstdError) as e:
        yield {"at": at, "error": str(e)}


def read_archives(stored: DataFrame, id_column: str = "archive_id", content: str = "content", with_payload: bool = True) -> DataFrame:
    """One row for each record of each archive, RECORD_SCHEMA; error is null where the record holds."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for some in batched(records(data.as_py() or b""), 200):  # an archive is decoded record by record
                    rows = [{"archive_id": number, **x} for x in some]
                    cols = [[r.get(n) if with_payload or n != "payload" else None for r in rows] for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return stored.select(F.col(id_column).cast("long"), F.col(content)).mapInArrow(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages into stored archives and returns what the reader finds in them, without the payloads."""
    stored = staged(archives(pages, trained_dictionary(pages)), "archives")
    return read_archives(stored, with_payload=False)
