"""Token ids, packed into rows of fixed length by best-fit decreasing.

Texts become ids of a public vocabulary, each document ended by END. A document longer than a row is split losslessly: full
rows and a rest, each piece with its offset. Pieces are dealt to shards of about SHARD_TOKENS by a hash of document, text and offset, and a
shard is packed alone: longest first (then by document and offset), each into the open
row with the least room that still fits it, found in a segment tree over room sizes in log2(row length) steps. A row holds
its ids as one padded line of the id matrix, the cumulative segment lengths, the places where positions start again at 0, and
for each segment its document and offset, from which unpacked() gives every document back.

What a row holds depends on the table alone, not on how its files are read, and no document is too long or too frequent for a shard. At
most one row in a shard is less than half full.

Defined results: a null or empty text is one segment holding END alone. Null ids are kept. Repeated rows are packed each.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import common as C

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before merging, as its description gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROW = 2048
SHARD_TOKENS, TOKEN_BYTES = 1 << 20, 3
#: White space of the pattern above; a run of over LONG of it would overflow its matcher's stack.
SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG = 1000
_RUN = re.compile(f"{SPACE}{{{LONG},}}")
PIECE_SCHEMA = "shard long, doc_id long, start long, ids binary"
SCHEMA = "row_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, piece_starts array<long>"
_ENCODINGS: dict[int, tiktoken.Encoding] = {}


def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    key = hash(vocabulary)
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


class RoomTree:
    """Open rows by the room they have left; least(n) finds the smallest room of at least n."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.has = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i, has = room + self.size, self.has
        while i and not has[i]:
            has[i] = 1
            i >>= 1

    def least(self, n: int) -> int:
        """The smallest room >= n that some row has, or -1."""
        i, has = n + self.size, self.has
        while not has[i]:
            while i & 1:  # a right child: nothing more under its parent
                i >>= 1
                if i <= 1:
                    return -1
            if i <= 1:
                return -1
            i += 1
        while i < self.size:
            i *= 2
            if not has[i]:
                i += 1
        return i - self.size

    def take(self, room: int) -> int:
        row = self.rows[room].pop()
        if not self.rows[room]:
            i, has = room + self.size, self.has
            has[i] = 0
            i >>= 1
            while i and not (has[2 * i] or has[2 * i + 1]):
                has[i] = 0
                i >>= 1
        return row


def best_fit(sizes: list[int], most: int) -> list[list[int]]:
    """Rows of indices into sizes, none over most in total, by best-fit decreasing (ties in order of index)."""
    tree, rows = RoomTree(most), []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        n = sizes[i]
        room = tree.least(n)
        if room < 0:
            room, row = most, len(rows)
            rows.append([])
        else:
            row = tree.take(room)
        rows[row].append(i)
        if room > n:
            tree.put(room - n, row)
    return rows


def token_ids(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The text's ids as the pattern and the vocabulary give them; of a long run of white space, all but the last is one piece for merging."""
    if not _RUN.search(text):
        return enc.encode_ordinary(text)
    ids, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += enc.encode_ordinary(text[at : run.start()])
        ids += enc._encode_single_piece(text[run.start() : end].encode())
        at = end
    return ids + enc.encode_ordinary(text[at:])


def _vocabulary(spark: SparkSession, path: str | None) -> Broadcast:
    """The vocabulary file's bytes (under 1 MB): of the path given, of the session's setting, or the default one."""
    with open(path or spark.conf.get("gleanery.vocabulary", VOCABULARY), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def packed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", row: int = ROW, vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """All documents' ids in rows of `row` ids, SCHEMA. ids holds little-endian uint16, or uint32 for larger vocabularies."""
    sent = _vocabulary(docs.sparkSession, vocabulary)
    shards = max(1, -(-C.text_bytes(docs, text_column) // (TOKEN_BYTES * shard_tokens)))

    def width_of(enc: tiktoken.Encoding) -> tuple[str, int]:
        return ("H", 2) if enc.n_vocab < 65535 else ("I", 4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(sent.value)
        code, width = width_of(enc)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                rows: list[tuple] = []
                for doc, cell in zip(batch.column(0)[lo : lo + 200].to_pylist(), batch.column(1)[lo : lo + 200], strict=True):
                    text = cell.as_py() or ""
                    raw = array(code, [*token_ids(enc, text), enc.n_vocab]).tobytes()
                    own = xxhash.xxh64_intdigest(text.encode(), 0 if doc is None else doc & 0xFFFFFFFFFFFFFFFF)
                    rows += [(xxhash.xxh64_intdigest(str(a).encode(), own) % shards, doc, a, raw[a * width : (a + row) * width]) for a in range(0, len(raw) // width, row)]
                yield C._rows(rows, ("shard", "doc_id", "start", "ids"), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))

    def shard(table: pa.Table) -> pa.Table:
        enc = encoding(sent.value)
        code, width = width_of(enc)
        pieces = sorted(zip(table["doc_id"].to_pylist(), table["start"].to_pylist(), table["ids"].to_pylist(), strict=True), key=lambda p: (p[0] is None, p[0] or 0, p[1], p[2]))
        sizes = [len(p[2]) // width for p in pieces]
        pad, number = array(code, [enc.n_vocab]).tobytes(), table["shard"][0].as_py() << 33
        out: list[tuple] = []
        for k, row_of in enumerate(best_fit(sizes, row)):
            ends = np.concatenate([[0], np.cumsum([sizes[i] for i in row_of])]).tolist()
            ids = b"".join([pieces[i][2] for i in row_of]) + pad * (row - ends[-1])
            out.append((number + k, ends[-1], ids, ends, ends[:-1], [pieces[i][0] for i in row_of], [pieces[i][1] for i in row_of]))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.Table.from_batches([C._rows(out, ("row_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "piece_starts"), kinds)])

    pieces = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(cut, PIECE_SCHEMA)
    return pieces.groupBy("shard").applyInArrow(shard, SCHEMA)


def unpacked(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, text): every document from its pieces. Ids must be unique and not null."""
    sent = _vocabulary(rows.sparkSession, vocabulary)
    width = 2 if len(sent.value.splitlines()) < 65535 else 4
    part = F.expr(f"substring(ids, cu_seqlens[k] * {width} + 1, (cu_seqlens[k + 1] - cu_seqlens[k]) * {width})")
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("doc_ids") - 1)).alias("k")).select(F.expr("doc_ids[k]").alias("doc_id"), F.expr("piece_starts[k]").alias("start"), part.alias("raw"))
    whole = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "raw"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(sent.value)
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["raw"] for p in parts), np.uint16 if width == 2 else np.uint32) for parts in batch.column(1).to_pylist()]
            texts = [enc.decode(x[:-1].tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(texts)], names=["doc_id", "n_tokens", "text"])

    return whole.mapInArrow(run, "doc_id long, n_tokens long, text string")
