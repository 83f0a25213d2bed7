"""Vectorised word scanning and hashing over Arrow string batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which on UTF-8 is the code-point class
``[^\\x20\\x09-\\x0D]``.  Texts are scanned in blocks of about ``BLOCK`` bytes, so temporaries stay a few MB
however large a batch is; one text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 18
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLES = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1 for _ in range(2)]
_STEP = [np.uint64(int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1) for _ in range(2)]
_INVERSES = [pow(b, -1, 1 << 64) for b in _BASES]
_powers: dict[int, np.ndarray] = {}
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        steps = np.full(size, np.uint64(base))
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 16 * BLOCK:  # a very long text's powers aren't kept
            _powers[base] = have
    return have[:n]


class Words:
    """The words of a block of texts: byte spans, the text each belongs to, and word hashes on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets.astype(np.int64)
        n = len(data)
        inside = ~_SEP[data]
        first = np.zeros(n + 1, bool)
        first[self.offsets[:-1]] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | first[:n]))
        first[self.offsets[1:]] = True
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.inside = inside
        self.first_word = np.searchsorted(self.starts, self.offsets)  # words before each text, and all
        self.counts = np.diff(self.first_word)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; two values of ``which`` give independent hashes."""
        table, base, inverse = _TABLES[which], _BASES[which], _INVERSES[which]
        n = len(self.data)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[self.data] * _power(base, n), out=total[1:])
        out = (total[self.ends] - total[self.starts]) * _power(inverse, n + 1)[self.starts]
        length = (self.ends - self.starts).astype(np.uint64)
        out = mix(out + length * np.uint64(0x9E3779B97F4A7C15))
        for i in np.flatnonzero(length > LONG_WORD):
            word = self.data[self.starts[i] : self.ends[i]].tobytes()
            out[i] = xxhash.xxh3_64_intdigest(word, seed=which + 1)
        return out

    def windows(self, k: int, words: np.ndarray, which: int = 0) -> np.ndarray:
        """The hash of the k words from each word on; only where ``valid(k)`` says so does it mean anything."""
        n = max(0, len(words) - k + 1)
        out = np.full(n, np.uint64(k))
        for j in range(k):
            out = out * _STEP[which] + words[j : j + n]
        return mix(out)

    def valid(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one text."""
        n = max(0, len(self.doc) - k + 1)
        return self.doc[:n] == self.doc[k - 1 : k - 1 + n]

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Words of text i (those that ``keep`` marks) joined by one space."""
        a, b = self.first_word[i], self.first_word[i + 1]
        if a == b:
            return b""
        lo, hi = self.offsets[i], self.offsets[i + 1]
        part, inside = self.data[lo:hi], self.inside[lo:hi].copy()
        if keep is None:
            inside[self.ends[a : b - 1] - lo] = True  # the byte after each word but the last
            out = part[inside]
            space = np.cumsum(self.ends[a:b] - self.starts[a:b] + 1)[:-1] - 1
            out[space] = 0x20
            return out.tobytes()
        raw, starts, ends = part.tobytes(), self.starts[a:b] - lo, self.ends[a:b] - lo
        return b" ".join([raw[starts[j] : ends[j]] for j in np.flatnonzero(keep)])


def blocks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for blocks of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        j = min(j, len(column))
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j


def task(run: Callable) -> Callable:
    """Hand memory back to the system when a task is over: workers live on, and executors have several."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
