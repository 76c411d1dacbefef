"""Suffix-array dedup by bytes: every string of `width` bytes that stands more than once is found, wherever its places lie.

A corpus of any size can't have one suffix array, so strings that are equal are first brought together, without loss. Each
window of `width` bytes picks an anchor: of its runs of GRAM bytes, the one of least hash, the leftmost of equals. That depends
on the window's bytes alone, so equal windows pick equal anchors, and the windows of a document that pick one place are
consecutive. Those in which at least half of the bytes beside the anchor stand before it make one segment, the others another;
all windows of a segment share the anchor and that half, which is the segment's key. So each window belongs to one segment,
and equal windows to segments of equal keys. Round 1 counts the kinds of segments by digest, and for each key whether it has several:
a segment that stands twice repeats as a whole; where segments of one key differ, one of each kind goes on. A block asks once a key,
and stores its segments, so that it finds them once.
Round 2 deals those by key to shards of about SHARD_BYTES, where a suffix array by induced sorting and the permuted common
prefixes say for each window if it stands twice in the shard. Two windows of a shard never are the same place, so a repeat
there is a repeat in the corpus, and no repeat is missed. A key of more than MANY kinds (a passage that countless documents
quote) would make its shard grow with the corpus: its windows are dealt singly, by digest, and sorted by it, which is as exact.

Defined results: a null or empty text has no bytes and one empty hash. Texts shorter than `width` are kept whole. Repeated rows
repeat each other. Null ids are kept. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common as C
from gleanery.llm.suffix_array import repeated_starts
from gleanery.session import staged

GRAM = 32
BASE = 0xD6E8FEB86659FD93
ASK_BYTES = 32 << 20
SHARD_BYTES = 1 << 20
#: A block asks 2 ** ASK_SHARDS shards in one row, searched one after another: rows would grow with blocks times shards.
ASK_SHARDS = 2
#: Digests and counts of single windows that a shard holds, about.
WINDOW_BYTES = 8 << 20
#: Places that are handled together: their numbers stay in a core's cache.
CACHED = 1 << 14
MANY = 256
#: The shard's and the replies' number under which a block keeps its segments.
STORED, KEPT = 1 << 40, 3
#: Tasks that search, at most; each takes one shard after another.
MOST_TASKS = 20_000
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
DIGEST_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class _Segments:
    """A block's segments: key, first and last window, digest; and one entry for each kind of them."""

    def __init__(self, block: C.Block, width: int):
        data, at = block.data, block.at
        grams, half = width - GRAM + 1, (width - GRAM) // 2
        full = np.flatnonzero(np.diff(at) >= width)
        self.width, self.raw = width, block.raw
        self.key, self.lo, self.hi = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        place: list[int] = []
        if len(full):
            sums = C.prefix_hash(data, BASE)
            least = _sliding_least(_gram_keys(sums), grams)
            ends = at[full + 1] - width + 1  # where each text's windows end; between two texts' windows some places begin none
            spans = list(zip(at[full].tolist(), ends.tolist(), strict=True))
            start = np.concatenate([np.arange(a, b, dtype=np.int32) for a, b in spans])
            pick = np.concatenate([least[a:b].astype(np.uint32) for a, b in spans]).view(np.int32)  # the lower half is the place
            before = pick - start >= half
            new = np.ones(len(start), bool)
            np.not_equal(pick[1:], pick[:-1], out=new[1:])
            new[1:] |= before[1:] != before[:-1]
            new[np.cumsum(ends - at[full])[:-1]] = True
            first = np.flatnonzero(new)
            self.lo, self.hi = (start[x].astype(np.int64) for x in (first, np.append(first[1:], len(start)) - 1))
            pick, before = pick[first].astype(np.int64), before[first]
            self.key = C.span_hash(sums, np.where(before, pick - half, pick), np.where(before, pick, pick + half) + GRAM, BASE) ^ before.astype(np.uint64)
            place = (pick - self.lo).tolist()
        raw, sha = block.raw, hashlib.sha256
        if len(self.lo):
            spans = zip(self.lo.tolist(), (self.hi + width).tolist(), place, strict=True)
            digest = b"".join([sha(raw[a:b] + p.to_bytes(4, "little")).digest()[:16] for a, b, p in spans])
        else:
            digest = b""
        pair = np.frombuffer(digest, np.uint64).reshape(-1, 2)
        order = np.lexsort((pair[:, 1], pair[:, 0], self.key))
        h, p = self.key[order], pair[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1]).any(axis=1)
        self.kind_of = np.empty(len(order), np.int64)
        self.kind_of[order] = np.cumsum(new) - 1
        self.anchor, self.digest = h[new], p[new]
        self.count = np.diff(np.append(np.flatnonzero(new), len(order)))
        self.example = order[new]
        first = np.concatenate([[True], self.anchor[1:] != self.anchor[:-1]])[: len(self.anchor)]
        self.keys, self.key_of = self.anchor[first], np.cumsum(first) - 1

    @classmethod
    def of(cls, block: C.Block, width: int, got: dict) -> _Segments:
        """As stored() left them with the block's replies; of keys and digests the first 32 bits, which say the shard."""
        if (KEPT, STORED) not in got:  # a block without segments
            return cls(block, width)
        self, raw = cls.__new__(cls), C.expand(got[KEPT, STORED])
        n, kinds = struct.unpack_from("<qq", raw)
        at = 16

        def column(kind, n: int) -> np.ndarray:
            nonlocal at
            at += (size := np.dtype(kind).itemsize * n)
            return C.from_planes(raw[at - size : at], kind, n)

        self.width, self.raw = width, block.raw
        self.lo = np.cumsum(column(np.int32, n), dtype=np.int64)
        self.hi = self.lo + column(np.int16, n)
        self.kind_of = column(np.int32, n).astype(np.int64)
        self.anchor = np.cumsum(column(np.uint32, kinds), dtype=np.uint64) << np.uint64(32)
        self.digest = column(np.uint32, kinds).astype(np.uint64)[:, None] << np.uint64(32)
        first = np.unpackbits(np.frombuffer(raw, np.uint8, offset=at), count=kinds).astype(bool)
        self.keys, self.key_of = self.anchor[first], np.cumsum(first) - 1
        self.example = np.empty(kinds, np.int64)
        self.example[self.kind_of[::-1]] = np.arange(n)[::-1]
        return self

    def stored(self) -> bytes:
        top = (self.anchor >> np.uint64(32)).astype(np.uint32)
        columns = (np.diff(self.lo, prepend=0).astype(np.int32), (self.hi - self.lo).astype(np.int16), self.kind_of.astype(np.int32), np.diff(top, prepend=np.uint32(0)), (self.digest[:, 0] >> np.uint64(32)).astype(np.uint32))
        first = np.diff(self.key_of, prepend=-1) > 0
        return C.squeeze(struct.pack("<qq", len(self.lo), len(top)) + b"".join(map(C.planes, columns)) + np.packbits(first).tobytes())

    def questions(self, bits: int) -> Iterator[tuple[int, bytes]]:
        """To shards by key: the keys, each one's least and greatest digest and its kinds, up to 65,535; to shards by digest: the kinds."""
        kinds = np.bincount(self.key_of, minlength=len(self.keys))
        at = np.cumsum(kinds) - kinds  # a key's kinds are sorted by digest
        least, most = (self.digest[at, 0], self.digest[at + kinds - 1, 0]) if len(at) else (np.zeros(0, np.uint64),) * 2
        for shard, k in _by_shard(self.keys, bits):
            several = k[kinds[k] > 1]
            yield shard, C.squeeze(struct.pack("<q", len(k)) + self.keys[k].tobytes() + least[k].tobytes() + np.minimum(65535, kinds[k]).astype(np.uint16).tobytes() + most[several].tobytes())
        for shard, k in _by_shard(self.digest[:, 0], bits):
            yield ~shard, C.squeeze(self.digest[k].tobytes() + np.minimum(2, self.count[k]).astype(np.uint8).tobytes())
        if len(self.lo):  # for the block itself, which so finds its segments once
            yield STORED, self.stored()

    def by_shard(self, bits: int, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Shard and those of the kinds `which` (ascending, so by anchor) that fall there."""
        shard = (self.anchor[which] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(which), np.int64)
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(shard)]]), strict=True):
            if hi > lo:
                yield int(shard[lo]), which[lo:hi]

    def windows(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of these kinds' examples, and their digests as two numbers each."""
        own = self.example[kinds]
        sizes = self.hi[own] - self.lo[own] + 1
        starts = np.repeat(self.lo[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(own) else np.zeros(0, np.int64)
        raw, sha, width = self.raw, hashlib.sha256, self.width
        return starts, np.frombuffer(b"".join([sha(raw[a : a + width]).digest()[:16] for a in starts.tolist()]), np.uint64).reshape(-1, 2)


def _gram_keys(sums: np.ndarray) -> np.ndarray:
    """For each place its run's hash of 32 bits before the place: the span hashes, taken a piece that a core's cache holds at a time."""
    n = len(sums) - GRAM
    out, inverse = np.empty(n, np.uint64), C.powers(BASE, len(sums), inverse=True)
    places = np.arange(min(n, CACHED), dtype=np.uint64)
    for lo in range(0, n, CACHED):
        h = out[lo : lo + CACHED]
        np.subtract(sums[lo + GRAM : lo + GRAM + len(h)], sums[lo : lo + len(h)], out=h)
        h *= inverse[lo : lo + len(h)]
        h[:] = C.mixed(h)
        h &= np.uint64(0xFFFFFFFF00000000)
        h |= places[: len(h)] + np.uint64(lo)
    return out


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys, from minima of doubling widths, a piece that a core's cache holds at a time."""
    n = len(key) - width + 1
    out = np.empty(n, np.uint64)
    for lo in range(0, n, CACHED):
        hi, wide = min(n, lo + CACHED), 1
        least = key[lo : hi + width - 1]
        while 2 * wide <= width:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        rest = width - wide  # two runs of `wide` keys cover the window
        np.minimum(least[: hi - lo], least[rest : rest + hi - lo], out=out[lo:hi])
    return out


def _grouped(first: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by (first, pair), where a new first starts in it and where a new (first, pair) does."""
    order = np.lexsort((pair[:, 1], pair[:, 0], first))
    a, p = first[order], pair[order]
    new_first = np.concatenate([[True], a[1:] != a[:-1]])
    new = new_first.copy()
    new[1:] |= (p[1:] != p[:-1]).any(axis=1)
    return order, new_first, new


def _over(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Each run's sum, at each of its members."""
    return np.add.reduceat(values, np.flatnonzero(new))[np.cumsum(new) - 1]


def _count_keys(asks: list[bytes]) -> list[bytes]:
    """For each block's keys: whether segments of several kinds have it, and whether MANY may (the blocks' kinds added up).

    Before these, two numbers: the block's kinds of keys of several kinds, and of those that MANY may have. They set the search's shards.
    """
    keys, least, most, counts, sizes = [], [], [], [], []
    for x in asks:
        raw = C.expand(x)
        n = struct.unpack_from("<q", raw)[0]
        keys.append(np.frombuffer(raw, np.uint64, n, offset=8))
        least.append(np.frombuffer(raw, np.uint64, n, offset=8 + 8 * n))
        counts.append(np.frombuffer(raw, np.uint16, n, offset=8 + 16 * n))
        top = least[-1].copy()
        top[counts[-1] > 1] = np.frombuffer(raw, np.uint64, offset=8 + 18 * n)
        most.append(top)
        sizes.append(n)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    flags = np.empty((2, len(order)), bool)
    flags[0, order] = (np.minimum.reduceat(np.concatenate(least)[order], at) != np.maximum.reduceat(np.concatenate(most)[order], at))[group]
    flags[1, order] = (np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), at) > MANY)[group]
    out = []
    for x, c in zip(np.split(flags, np.cumsum(sizes)[:-1], axis=1), counts, strict=True):
        kinds = (int(c[x[0] & few].sum(dtype=np.int64)) for few in (~x[1], x[1]))
        out.append(struct.pack(">qq", *kinds) + np.packbits(x, axis=1).tobytes())
    return out


def _count_kinds(asks: list[bytes]) -> list[bytes]:
    """For each block's kinds of segments: whether it stands twice, and whether this block is the first that has it."""
    pairs, counts, sizes = [], [], []
    for x in asks:
        raw = C.expand(x)
        n = len(raw) // 17
        pairs.append(np.frombuffer(raw, np.uint64, 2 * n).reshape(-1, 2))
        counts.append(np.frombuffer(raw, np.uint8, n, offset=16 * n))
        sizes.append(n)
    pair = np.concatenate(pairs)
    order, _, new = _grouped(np.zeros(len(pair), np.int8), pair)
    flags = np.empty((2, len(order)), bool)
    flags[0, order] = _over(np.concatenate(counts)[order].astype(np.int64), new) > 1
    flags[1, order] = new  # the sort is stable, so the first of a kind is the smallest block's
    return [np.packbits(x, axis=1).tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1], axis=1)]


def _count_windows(asks: list[bytes]) -> list[bytes]:
    """For each block's distinct windows, whether they stand twice; each comes with its count in the block, up to 2."""
    pairs, counts, sizes = [], [], []
    for x in asks:
        raw = C.expand(x)
        n = len(raw) // 17
        pairs.append(np.frombuffer(raw, np.uint64, 2 * n).reshape(-1, 2))
        counts.append(np.frombuffer(raw, np.uint8, n, offset=16 * n))
        sizes.append(n)
    pair = np.concatenate(pairs)
    order, _, new = _grouped(np.zeros(len(pair), np.int8), pair)
    twice = np.empty(len(order), bool)
    twice[order] = _over(np.concatenate(counts)[order].astype(np.int64), new) > 1
    return [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum(sizes)[:-1])]


def _search(asks: list[bytes], width: int, inner_bits: int) -> list[bytes]:
    """For each block's segments, which of their windows stand twice among all segments of their shard; the asks hold 2 ** inner_bits shards."""
    texts, cuts = [], []
    for x in asks:
        raw = C.expand(x)
        n = struct.unpack_from("<q", raw)[0]
        inner = np.frombuffer(raw, np.int32, 1 << inner_bits, offset=8)
        head = 8 + inner.nbytes
        at = head + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int32, n, offset=head))])
        texts.append([raw[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)])
        cuts.append([0, *np.cumsum(inner).tolist()])
    out: list[list[np.ndarray]] = [[] for _ in asks]
    for k in range(1 << inner_bits):
        some = [x[c[k] : c[k + 1]] for x, c in zip(texts, cuts, strict=True)]
        if any(some):
            found = iter(repeated_starts([t for x in some for t in x], width))
            for x, flags in zip(some, out, strict=True):
                flags += itertools.islice(found, len(x))
    return [np.packbits(np.concatenate(x)).tobytes() for x in out]


def _flags(data: bytes, n: int) -> np.ndarray:
    """Two rows of n flags as the counting steps pack them."""
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(2, -1), axis=1, count=n).astype(bool)


def _read_kinds(segments: _Segments, got: dict, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each kind: stands twice, goes on to the search (once from all blocks), has a key of MANY kinds."""
    several = np.zeros((2, len(segments.keys)), bool)
    for shard, k in _by_shard(segments.keys, bits):
        several[:, k] = _flags(got[1, shard][16:], len(k))
    own = np.zeros((2, len(segments.anchor)), bool)
    for shard, k in _by_shard(segments.digest[:, 0], bits):
        own[:, k] = _flags(got[1, ~shard], len(k))
    several = several[:, segments.key_of]
    return own[0], own[1] & several[0], several[1]


def _by_shard(values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard and the places of the values that fall there by their first bits."""
    shard = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(order)]]), strict=True):
        if hi > lo:
            yield int(shard[order[lo]]), order[lo:hi]


def _distinct(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digests in order, how often each stands, and each digest's place among them."""
    order, _, new = _grouped(np.zeros(len(pair), np.int8), pair) if len(pair) else (np.zeros(0, np.int64), None, np.zeros(0, bool))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return pair[order[new]], np.diff(np.append(np.flatnonzero(new), len(order))), place


def _sharded(pair: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    shard = (pair[:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(pair), np.int64)
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(shard)]]), strict=True):
        if hi > lo:
            yield int(shard[lo]), int(lo), int(hi)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 400, digest: bool = False) -> DataFrame:
    """Each document without the bytes of any string of `width` bytes that also starts elsewhere.

    Columns: doc_id, n_bytes, n_removed, n_spans and the kept bytes (digest: their SHA-256 in their place).
    """
    total = C.text_bytes(docs, text_column)
    blocks = C.blocks_of(docs, id_column, text_column, total)
    bits = C.shard_bits(total, ASK_BYTES)

    asks = staged(C.ask_first(blocks, lambda block: _Segments(block, width).questions(bits)), "questions")
    own = asks.where(F.col("shard") == STORED).select("slot", "block", F.lit(KEPT).alias("kind"), "shard", "data")
    kinds = staged(C.answered(asks.where(f"shard >= 0 and shard < {STORED}"), _count_keys, 1).unionByName(C.answered(asks.where("shard < 0"), _count_kinds, 1)), "kinds")
    # kinds that several blocks have count once in each, so these are upper bounds of what goes on; a kind has some (width - GRAM) // 4 windows
    number = lambda at: F.coalesce(F.sum(F.conv(F.hex(F.substring("data", at, 8)), 16, 10).cast("long")), F.lit(0))
    few, many = kinds.where("shard >= 0").agg(number(1), number(9)).first()
    search_bits = C.shard_bits(few * (width + (width - GRAM) // 4), SHARD_BYTES)
    window_bits = C.shard_bits(many * ((width - GRAM) // 4) * 17, WINDOW_BYTES)
    inner_bits = min(ASK_SHARDS, search_bits)

    def ask_search(block: C.Block, number: tuple[int, int], got: dict) -> pa.Table:
        s = _Segments.of(block, width, got)
        _, send, many = _read_kinds(s, got, bits)
        rows = []
        for shard, k in s.by_shard(search_bits - inner_bits, np.flatnonzero(send & ~many)):
            own = s.example[k]
            inner = np.zeros(1 << inner_bits, np.int32)
            for place, x in s.by_shard(search_bits, k):
                inner[place & (1 << inner_bits) - 1] = len(x)
            parts = [block.raw[a:b] for a, b in zip(s.lo[own].tolist(), (s.hi[own] + width).tolist(), strict=True)]
            lens = np.array([len(x) for x in parts], np.int32)
            rows.append((shard, *number, C.squeeze(struct.pack("<q", len(parts)) + inner.tobytes() + lens.tobytes() + b"".join(parts))))
        pair, count, _ = _distinct(s.windows(np.flatnonzero(send & many))[1])
        for shard, lo, hi in _sharded(pair, window_bits):  # single windows go to shards of negative numbers
            rows.append((~shard, *number, C.squeeze(pair[lo:hi].tobytes() + np.minimum(2, count[lo:hi]).astype(np.uint8).tobytes())))
        return pa.Table.from_batches([C.asked(rows)])

    asks = staged(C.with_replies(blocks, kinds.unionByName(own), ask_search, C.ASK_SCHEMA), "asks")
    searched = C.answered(asks.where("shard >= 0"), lambda x: _search(x, width, inner_bits), 2, min(MOST_TASKS, 1 << search_bits - inner_bits))
    windows = staged(searched.unionByName(C.answered(asks.where("shard < 0"), _count_windows, 2)), "windows")

    def clean(block: C.Block, number: tuple[int, int], got: dict) -> pa.Table:
        s = _Segments.of(block, width, got)
        twice, send, many = _read_kinds(s, got, bits)
        whole = np.flatnonzero(twice[s.kind_of])
        edge = np.zeros(len(block.data) + 1, np.int8)  # segments don't overlap, so no two begin or end at one place
        edge[s.lo[whole]] += 1
        edge[s.hi[whole] + 1] -= 1
        hit = np.cumsum(edge[:-1], dtype=np.int8) > 0
        for shard, k in s.by_shard(search_bits - inner_bits, np.flatnonzero(send & ~many)):
            own = s.example[k]
            sizes = s.hi[own] - s.lo[own] + 1
            flags = np.unpackbits(np.frombuffer(got[2, shard], np.uint8), count=int(sizes.sum())).astype(bool)
            places = np.repeat(s.lo[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            hit[places[flags]] = True
        starts, digests = s.windows(np.flatnonzero(send & many))
        pair, _, place = _distinct(digests)
        again = np.zeros(len(pair), bool)
        for shard, lo, hi in _sharded(pair, window_bits):
            again[lo:hi] = np.unpackbits(np.frombuffer(got[2, ~shard], np.uint8), count=hi - lo).astype(bool)
        hit[starts[again[place]]] = True
        gone = C.covered_from(hit, width)
        at = block.at
        sums = C.counts_before(gone).astype(np.int64)
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = at[:-1][(at[:-1] < len(gone))]
        opens[inner] = gone[inner]  # a document's first byte opens a run of its own
        spans = C.counts_before(opens).astype(np.int64)
        kept = block.data[~gone].tobytes()
        left = (at - sums[at]).tolist()
        parts = [kept[a:b] for a, b in zip(left, left[1:], strict=False)]
        last = pa.array([hashlib.sha256(x).hexdigest() for x in parts]) if digest else pa.array(parts, pa.binary())
        return pa.table({"doc_id": C.ids_column(block.ids), "n_bytes": np.diff(at), "n_removed": np.diff(sums[at]), "n_spans": np.diff(spans[at]), "kept_sha256" if digest else "kept": last})

    return C.with_replies(blocks, kinds.unionByName(own).unionByName(windows), clean, DIGEST_SCHEMA if digest else SCHEMA)
