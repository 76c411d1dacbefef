"""Substring dedup by words: a count-min prefilter, then exact grouping of what may repeat.

Pass 1: each block (a few MB of one partition's texts) makes a count-min sketch of its windows of `width` words: two rows of
counters, dealt by hash in shards, of which it sends the cells that aren't zero with their counts. A shard adds the blocks'
sketches up and tells each block which of its cells now exceed 1. A window's estimate is the lesser of its two counters, never too low, so
where either is 1 the window stands once and is settled. Pass 2: only windows estimated repeated are sent on, as SHA-256 digests (128 bits of it)
of their words with the block's smallest document; the shard groups them exactly. The number of shards follows the input, so a
table's load, and with it the share of windows passed on in vain, is the same at any size.

Defined results: a null or empty text has no words. Equal ids are not smaller than each other, so repeated rows of one id
keep their words. A null id counts as larger than every other. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm import common as C
from gleanery.session import staged

BASE = 0x9E3779B97F4A7C15
SCHEMA = "doc_id long, n_words long, n_removed long, kept string"
DIGEST_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: Windows of a shard; its two sketch rows have four cells for each.
WINDOWS_A_SHARD = 1 << 22
CELL_BITS = 24
#: Text of a block: the larger, the closer the cells of its sketch lie and the fewer bits each takes.
BLOCK_BYTES = 4 << 20


def words_of(text: bytes) -> bytes:
    """Words (runs without ASCII white space) joined by one space, then a line end."""
    return b" ".join(text.split()) + b"\n"


class _Words:
    """Where a block's words start and end, which document holds each, and each full window's hash."""

    def __init__(self, block: C.Block, width: int):
        data = block.data
        ends = np.flatnonzero((data == 32) | (data == 10))
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        doc = np.searchsorted(block.at[1:], starts, side="right")
        real = ends > starts
        self.start, self.end, self.doc = starts[real], ends[real], doc[real]
        n = len(self.start)
        first = np.arange(max(0, n - width + 1))
        self.window = first[self.doc[first] == self.doc[first + width - 1]] if len(first) else first
        self.last = self.window + width - 1
        sums = C.prefix_hash(data, BASE)
        self.hash = C.span_hash(sums, self.start[self.window], self.end[self.last], BASE)
        self.order = np.argsort(self.hash)

    def by_shard(self, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Shard, the windows (indices into window) that fall there in order of hash, and their 32 further bits."""
        hashes = self.hash[self.order]
        shard = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        key = (hashes << np.uint64(bits)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(shard)]]), strict=True):
            if hi > lo:
                yield int(shard[lo]), self.order[lo:hi], key[lo:hi]


def _cells(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of a sketch the cells that these keys count in, ascending, each key's place among them, and the counts."""
    for factor in (1, 0x9E3779B1):
        cell = ((keys * np.uint64(factor) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CELL_BITS)).astype(np.uint32)
        yield np.unique(cell, return_inverse=True, return_counts=True)


def _sketch(keys: np.ndarray) -> bytes:
    """One block's counters of a shard: for each row how many aren't zero, the gaps between them and their counts, up to 255."""
    out = b""
    for cells, _, counts in _cells(keys):
        out += struct.pack("<q", len(cells)) + C.planes(np.diff(cells, prepend=np.uint32(0))) + np.minimum(255, counts).astype(np.uint8).tobytes()
    return C.squeeze(out)


def _merge_sketches(asks: list[bytes]) -> list[bytes]:
    """Adds up the blocks' sketches of a shard and says, for each counter that a block sent, if the sum exceeds 1."""
    sketches = []
    for x in asks:
        raw, at, rows = C.expand(x), 0, []
        for _ in range(2):
            n = struct.unpack_from("<q", raw, at)[0]
            cells = np.cumsum(C.from_planes(raw[at + 8 : at + 8 + 4 * n], np.uint32, n), dtype=np.int64)
            rows.append((cells, np.frombuffer(raw, np.uint8, n, offset=at + 8 + 4 * n)))
            at += 8 + 5 * n
        sketches.append(rows)
    over = [[], []]
    for row in range(2):
        table = np.zeros(1 << CELL_BITS, np.uint8)
        for rows in sketches:
            cells, counts = rows[row]
            table[cells] = np.minimum(255, table[cells].astype(np.uint16) + counts).astype(np.uint8)
        over[row] = [np.packbits(table[rows[row][0]] > 1).tobytes() for rows in sketches]
    return [a + b for a, b in zip(*over, strict=True)]


def _group_exactly(asks: list[bytes]) -> list[bytes]:
    """For each block's digests, whether a smaller document than the block's own smallest has it too."""
    digests, docs, sizes = [], [], []
    for x in asks:
        raw = C.expand(x)
        n = len(raw) // 24
        digests.append(np.frombuffer(raw, np.dtype("V16"), n))
        docs.append(C.from_planes(raw[16 * n :], np.int64, n))
        sizes.append(n)
    pair = np.concatenate(digests).view(np.uint64).reshape(-1, 2)
    doc = np.concatenate(docs)
    order = np.lexsort((doc, pair[:, 1], pair[:, 0]))
    p = pair[order]
    new = np.ones(len(order), bool)
    new[1:] = (p[1:] != p[:-1]).any(axis=1)
    least = doc[order][new][np.cumsum(new) - 1]
    smaller = np.empty(len(order), bool)
    smaller[order] = least < doc[order]
    return [np.packbits(x).tobytes() for x in np.split(smaller, np.cumsum(sizes)[:-1])]


def _repeated(words: _Words, got: dict, bits: int) -> np.ndarray:
    """Windows that the merged sketches estimate repeated, in order of the words."""
    flag = np.zeros(len(words.window), bool)
    for shard, windows, keys in words.by_shard(bits):
        reply, at, own = got[1, shard], 0, np.ones(len(windows), bool)
        for cells, place, _ in _cells(keys):
            size = -(-len(cells) // 8)
            own &= np.unpackbits(np.frombuffer(reply, np.uint8, size, offset=at), count=len(cells)).astype(bool)[place]
            at += size
        flag[windows] = own
    return np.flatnonzero(flag)


def _digests(block: C.Block, words: _Words, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digests of these windows (as two numbers each, sorted), the smallest document of each, each window's place."""
    raw, sha = block.raw, hashlib.sha256
    spans = zip(words.start[words.window[windows]].tolist(), words.end[words.last[windows]].tolist(), strict=True)
    pair = np.frombuffer(b"".join([sha(raw[s:e]).digest()[:16] for s, e in spans]), np.uint64).reshape(-1, 2)
    doc = block.ids[words.doc[words.window[windows]]]
    order = np.lexsort((doc, pair[:, 1], pair[:, 0]))
    p = pair[order]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (p[1:] != p[:-1]).any(axis=1)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return p[new], doc[order][new], place


def _cut(pair: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Shard and the slice of the sorted digests that it takes."""
    shard = (pair[:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(pair), np.int64)
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(shard)]]), strict=True):
        if hi > lo:
            yield int(shard[lo]), int(lo), int(hi)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 13, digest: bool = False) -> DataFrame:
    """Each document without the words of any `width`-word window that also starts in a document of a smaller id.

    Columns: doc_id, n_words, n_removed and the kept words joined by one space (digest: their SHA-256 in its place).
    """
    total = C.text_bytes(docs, text_column)
    bits = C.shard_bits(total // 6, WINDOWS_A_SHARD)
    blocks = C.blocks_of(docs, id_column, text_column, total, words_of, BLOCK_BYTES)

    def sketch(block: C.Block) -> Iterator[tuple[int, bytes]]:
        for shard, _, keys in _Words(block, width).by_shard(bits):
            yield shard, _sketch(keys)

    estimates = staged(C.answered(C.ask_first(blocks, sketch), _merge_sketches, 1), "estimates")

    def ask(block: C.Block, number: tuple[int, int], got: dict) -> pa.Table:
        words = _Words(block, width)
        pair, doc, _ = _digests(block, words, _repeated(words, got, bits))
        return pa.Table.from_batches([C.asked([(s, *number, C.squeeze(pair[lo:hi].tobytes() + C.planes(doc[lo:hi]))) for s, lo, hi in _cut(pair, bits)])])

    asks = C.with_replies(blocks, estimates, ask, C.ASK_SCHEMA)
    exact = staged(C.answered(asks, _group_exactly, 2), "repeats")

    def clean(block: C.Block, number: tuple[int, int], got: dict) -> pa.Table:
        words = _Words(block, width)
        windows = _repeated(words, got, bits)
        pair, doc, place = _digests(block, words, windows)
        smaller = np.zeros(len(pair), bool)
        for shard, lo, hi in _cut(pair, bits):
            smaller[lo:hi] = np.unpackbits(np.frombuffer(got[2, shard], np.uint8), count=hi - lo).astype(bool)
        own = block.ids[words.doc[words.window[windows]]]
        hit = np.zeros(len(words.start), bool)
        hit[words.window[windows]] = smaller[place] | (doc[place] < own)
        gone = C.covered_from(hit, width)
        n_docs = len(block.ids)
        n_words = np.bincount(words.doc, minlength=n_docs)
        n_gone = np.bincount(words.doc[gone], minlength=n_docs)
        mask = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(mask, words.start[~gone], 1)
        np.add.at(mask, words.end[~gone] + 1, -1)
        left = np.cumsum(mask[:-1]) > 0
        kept = block.data[left].tobytes()
        at = np.concatenate([[0], np.cumsum(left)])[block.at].tolist()
        parts = [kept[a : max(a, b - 1)] for a, b in zip(at, at[1:], strict=False)]
        last = pa.array([hashlib.sha256(x).hexdigest() for x in parts]) if digest else pa.array(parts, pa.binary()).cast(pa.string())
        return pa.table({"doc_id": C.ids_column(block.ids), "n_words": n_words, "n_removed": n_gone, "kept_sha256" if digest else "kept": last})

    return C.with_replies(blocks, estimates.unionByName(exact), clean, DIGEST_SCHEMA if digest else SCHEMA)
