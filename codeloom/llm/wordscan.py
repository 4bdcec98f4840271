"""Vectorised word cutting and hashing over Arrow text columns (numpy, inside tasks).

A word is a maximal run of characters other than space and ``\\t``-``\\r``; those
are single bytes in UTF-8, so words are cut on bytes.  Null text holds no words.
Word hashes are 64-bit; :func:`window_hash` folds ``k`` consecutive ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEGMENT = 1 << 18
#: odd multipliers of the polynomial hashes
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _times(a: np.uint64, b: np.uint64) -> np.uint64:
    """a * b modulo 2**64 (numpy warns where scalars wrap)."""
    return np.uint64(int(a) * int(b) & 0xFFFFFFFFFFFFFFFF)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * _times(out[done - 1], base)
        done += step
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


class Words:
    """Words of a batch of texts: byte ``start``/``end`` of each, and ``first``,
    the index of each text's first word (one entry more than texts).  ``separator``
    says which bytes end a word."""

    def __init__(self, column: pa.Array, lower: bool = False, separator: np.ndarray = SEPARATOR):
        raw, off = text_bytes(column)
        self.raw = LOWER[raw] if lower else raw
        self.offsets = off
        self.value = np.where(separator, 0, np.arange(256) + 1).astype(np.uint64)
        inside = ~separator[raw]
        n = len(raw)
        begins = inside.copy()
        ends = inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            heads = off[:-1][off[:-1] < off[1:]]
            begins[heads] = inside[heads]
            tails = off[1:][off[:-1] < off[1:]] - 1
            ends[tails] = inside[tails]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off).astype(np.int64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        out = np.empty(len(self.start), dtype=np.uint64)
        i, total = 0, len(out)
        powers = np.ones(1, dtype=np.uint64)
        while i < total:
            lo = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, lo + SEGMENT, "right")))
            hi = self.end[j - 1]
            piece = self.raw[lo:hi]
            begin, stop = self.start[i:j] - lo, self.end[i:j] - lo
            length = stop - begin
            if length.max() >= len(powers):
                powers = _powers(BYTE_BASE, int(length.max()) + 1)
            # bytes are weighted by their place from the word's start; separators count 0
            place = np.arange(hi - lo, dtype=np.int32)
            place -= np.repeat(begin.astype(np.int32), np.diff(np.append(begin, hi - lo)))
            valued = self.value[piece] * powers.take(place, mode="clip")
            out[i:j] = np.add.reduceat(valued, begin) + length.astype(np.uint64)
            i = j
        return mix(out)


def window_hash(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of every ``k`` consecutive entries (windows crossing text ends included;
    the caller keeps those that lie inside one text)."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(h) - k + 1
    base = WORD_BASES[lane]
    total = np.zeros(n, dtype=np.uint64)
    level, width, scale, at, weight = h, 1, base, 0, k
    # doubling: `level` hashes runs of `width` words; the binary digits of k say which to use
    while True:
        if weight & 1:
            total = total * scale + level[at:at + n]
            at += width
        weight >>= 1
        if not weight:
            break
        level = level[:-width] * scale + level[width:]
        scale = _times(scale, scale)
        width *= 2
    return mix(total)


def inside(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word index, text index) of every window of ``k`` words within one text."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    base = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(len(text)) + base, text
