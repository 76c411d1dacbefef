"""Suffix arrays by induced sorting, in numpy, and permuted common prefixes.

Induced sorting visits one bucket of a first symbol after the other. What a bucket holds at that point is handled as one
array step (a wave): the suffixes one place before its members go to the ends of their own buckets, in the members' order.
Members that such a step adds to the bucket itself are the next wave, so the number of steps is the number of symbols plus
the longest run of one symbol, and the work is linear in the text. Reduced strings, whose buckets hold a few members each, are induced by the
same two passes one suffix after another, since an array step would cost more than a bucket's members.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Members of a bucket, on average, from which on buckets are taken as arrays.
WAVE = 64


def classified(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol is a unique smallest one and counts as smaller."""
    n = len(t)
    smaller = np.ones(n, bool)
    if n > 1:
        differs = t[:-1] != t[1:]
        at = np.where(differs, np.arange(n - 1, dtype=np.int32), np.int32(n))
        at = np.minimum.accumulate(at[::-1])[::-1]
        smaller[:-1] = (t[:-1] < t[1:])[at]
    return smaller


def _induced(t: np.ndarray, smaller: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in theirs; starts are the buckets' and the end."""
    n, k = len(t), len(starts) - 1
    if n < WAVE * k:
        return _induced_singly(t, smaller, starts, lms)
    sa = np.empty(n, np.int32)
    lms_by = lms[np.argsort(t[lms], kind="stable")]
    cuts = np.searchsorted(t[lms_by], np.arange(k + 1))
    head = starts[:-1].copy()
    used = np.flatnonzero(np.diff(starts))

    def forward(wave: np.ndarray) -> None:
        pred = wave - 1
        pred = pred[pred >= 0]
        pred = pred[~smaller[pred]]
        if len(pred):
            c = t[pred]
            order = np.argsort(c, kind="stable")
            c, pred = c[order], pred[order]
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            size = np.diff(np.append(first, len(c)))
            sa[np.repeat(head[c[first]] - first, size) + np.arange(len(c))] = pred
            head[c[first]] += size

    for c in used.tolist():
        done = starts[c]
        while done < head[c]:
            wave, done = sa[done : head[c]], head[c]
            forward(wave)
        if cuts[c + 1] > cuts[c]:
            forward(lms_by[cuts[c] : cuts[c + 1]])

    tail = starts[1:].copy()

    def backward(wave: np.ndarray) -> None:
        pred = wave - 1
        pred = pred[pred >= 0]
        pred = pred[smaller[pred]]
        if len(pred):
            c = t[pred]
            order = np.argsort(c, kind="stable")
            c, pred = c[order], pred[order]
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            size = np.diff(np.append(first, len(c)))
            sa[np.repeat(tail[c[first]] - 1 + first, size) - np.arange(len(c))] = pred
            tail[c[first]] -= size

    for c in used[::-1].tolist():
        done = starts[c + 1]
        while done > tail[c]:
            wave, done = sa[tail[c] : done][::-1], tail[c]
            backward(wave)
        if head[c] > starts[c]:
            backward(sa[starts[c] : head[c]][::-1])
    sa[0] = n - 1
    return sa


def _induced_singly(t: np.ndarray, smaller: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same for many small buckets: leftmost-smaller ones to their buckets' ends, then a pass forward and one back."""
    n = len(t)
    before = np.full((2, n + 1), -1, np.int32)  # of each pass: the symbol before a suffix that goes to its bucket then; the last one is an empty place's
    before[0, 1:n][~smaller[:-1]] = t[:-1][~smaller[:-1]]
    before[1, 1:n][smaller[:-1]] = t[:-1][smaller[:-1]]
    own = t[lms]
    order = np.argsort(own, kind="stable")
    own = own[order]
    sa = np.full(n, -1, np.int32)
    sa[starts[1:][own] - np.searchsorted(own, own, "right") + np.arange(len(own))] = lms[order]
    sa, symbol, head = sa.tolist(), before[0].tolist(), starts[:-1].tolist()
    for i in sa:
        c = symbol[i]
        if c >= 0:
            k = head[c]
            sa[k] = i - 1
            head[c] = k + 1
    symbol, tail = before[1].tolist(), starts[1:].tolist()
    for i in reversed(sa):
        c = symbol[i]
        if c >= 0:
            k = tail[c] = tail[c] - 1
            sa[k] = i - 1
    sa[0] = n - 1
    return np.frombuffer(array("i", sa), np.int32)


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """The order of all suffixes of t, whose values are below `symbols` and whose last one is a unique smallest 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    smaller = classified(t)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=symbols))])
    sa = _induced(t, smaller, starts, lms)
    place = np.full(n, -1, np.int32)
    place[lms] = np.arange(len(lms))
    by_substring = sa[place[sa] >= 0]
    del sa
    length = np.ones(n, np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    a, b = by_substring[:-1], by_substring[1:]
    same = np.flatnonzero(length[a] == length[b])
    equal = np.zeros(len(a), bool)
    step = 0
    while len(same):  # compare neighbours symbol by symbol; those that end while equal are equal
        ended = length[a[same]] <= step
        equal[same[ended]] = True
        same = same[~ended]
        same = same[t[a[same] + step] == t[b[same] + step]]
        step += 1
    names = np.concatenate([[0], np.cumsum(~equal)])
    count = int(names[-1]) + 1
    order = place[by_substring]
    if count < len(lms):
        reduced = np.empty(len(lms), np.uint16 if count < 65536 else np.int32)  # 16 bits are sorted by radix
        reduced[order] = names
        order = suffix_array(reduced, count)
    return _induced(t, smaller, starts, lms[order])


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int, chunk: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For each place of data, the suffix before it in order (itself if none) and their common prefix, up to `most` bytes.

    Permuted common prefixes shrink by at most one from a place to the next, so each chunk of places is walked from its first;
    all chunks take their steps together, eight bytes at a time. sa may hold places beyond data (a last sentinel's).
    """
    n = len(data)
    before = np.arange(n, dtype=np.int32)
    ok = (sa[1:] < n) & (sa[:-1] < n)
    before[sa[1:][ok]] = sa[:-1][ok]
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    found = np.zeros(n, np.int32)
    base = np.arange(0, n, chunk)
    so_far = np.zeros(len(base), np.int64)
    for j in range(chunk):
        base = base[base + j < n]
        i = base + j
        size = np.maximum(so_far[: len(i)] - 1, 0)
        p = before[i]
        live = np.flatnonzero((p != i) & (size < most))
        size[p == i] = 0
        while len(live):
            x = words[i[live] + size[live]] ^ words[p[live] + size[live]]
            same = x == 0
            size[live] += np.where(same, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
            live = live[same]
            live = live[size[live] < most]
        size = np.minimum(size, np.minimum(most, n - np.maximum(i, p)))
        so_far[: len(i)] = size
        found[i] = size
    return before, found


#: Not a byte of any UTF-8 text: stands between two texts.
SEPARATOR = 0xFF


def repeated_starts(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text, whether the `width` bytes from each place (as far as they fit) also start elsewhere in any of them."""
    joined = np.frombuffer(bytes([SEPARATOR]).join(texts), np.uint8)
    t = np.append(joined.astype(np.uint16) + np.uint16(1), np.uint16(0))
    sa = suffix_array(t, 258)
    before, common = common_prefixes(joined, sa, width)
    hit = common >= width
    again = np.zeros(len(joined), bool)
    again[hit] = True
    again[before[hit]] = True
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    return [again[a : a + max(0, len(x) - width + 1)] for a, x in zip(at.tolist(), texts, strict=False)]
