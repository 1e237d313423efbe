"""Words of many texts at once, on the UTF-8 bytes that Arrow holds.

A batch of texts is one byte buffer and the offsets of the texts in it. Word borders come
from a table of 256 flags, and the hash of a word from prefix sums of a polynomial modulo
2**64, so that the work per byte is a few array operations whatever the texts look like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18  # texts are taken together up to this size; a longer text is taken alone
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def flags(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Table of 256 flags, set within the given byte ranges (ends included)."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Bytes of words, as the two word definitions in use state them.
NOT_SPACE = ~flags([(0x20, 0x20), (0x09, 0x0D)])
NOT_PUNCT = ~flags([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), CHUNK_BYTES + 1)
        full, back = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        full[0] = back[0] = 1
        with np.errstate(over="ignore"):
            _powers, _inverses = np.cumprod(full), np.cumprod(back)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bit mixer over uint64 values; ``seed`` gives different mixers."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets from 0) for runs of whole texts of about ``limit`` bytes."""
    data, at = buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any byte range follows (see ``range_hash``)."""
    full, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * full, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One uint64 for each byte range, equal for equal bytes wherever they stand."""
    _, back = powers(len(prefix))
    return (prefix[ends] - prefix[starts]) * back[starts]


def find_words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words; no word crosses the end of a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, lower-cased (A-Z) hashes and, per text, the index of its first word (with the total at the end)."""
    low = LOWER[data]
    starts, ends = find_words(low, at, kind)
    hashes = mix(range_hash(prefix_hash(low), starts, ends))
    return starts, hashes, np.searchsorted(starts, at, side="left")


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, .., c-1 for each count c, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


class Lookup:
    """Values of known hashes: a bit table sends most unknown hashes away before the binary search."""

    BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = np.asarray(keys, np.uint64)[order], np.asarray(values)[order]
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self._slot(self.keys)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the known hashes and their values."""
        at = np.flatnonzero(self.table[self._slot(hashes)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), self.values[:0]
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        good = self.keys[place] == hashes[at]
        return at[good], self.values[place[good]]
