"""Splitting Arrow string columns into words and hashing words and word n-grams, in numpy.

Bytes are classified by a table, word hashes come from differences of one cumulative polynomial over a block of about
a megabyte, and n-gram hashes from doubling, so that no Python code runs for each word. Arithmetic is modulo 2**64 with
an odd base, followed by a mixing step; two different n-grams collide with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BLOCK = 1 << 20


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Bytes of words `[^\x20\x09-\x0D]+`, and of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing A-Z).
NOT_SPACE = ~_table((0x09, 0x0D), (0x20, 0x20))
LETTERS_DIGITS = _table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_BASE, _BLOCK)
_INV = _powers(pow(_BASE, -1, 1 << 64), _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads each bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(2)
def _powers_of(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, _BLOCK), _powers(pow(base, -1, 1 << 64), _BLOCK)


def _hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of buf[s:e] for each word; blocks end between words, so that long texts need no more memory than short ones."""
    out = np.empty(len(s), np.uint64)
    pow_, inv = (_POW, _INV) if base == _BASE else _powers_of(base)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + _BLOCK, "right")))
        lo, hi = int(s[i]), int(e[j - 1])
        powers, inverse = (pow_, inv) if hi - lo <= _BLOCK else (_powers(base, hi - lo), inv)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * powers[: hi - lo], out=sums[1:])
        out[i:j] = (sums[e[i:j] - lo] - sums[s[i:j] - lo]) * inverse[s[i:j] - lo]
        i = j
    return mix(out ^ (e - s).astype(np.uint64))


class Words:
    """Words of the rows lo..hi of a column: of row lo + k, the words off[k]..off[k + 1], at buf[s:e], with hashes h."""

    def __init__(self, lo: int, hi: int, buf: np.ndarray, ends: np.ndarray, is_word: np.ndarray, lower: bool):
        self.lo, self.hi = lo, hi
        self.buf = buf = LOWER[buf] if lower else buf
        w = np.zeros(len(buf) + 2, np.int8)
        w[1:-1] = is_word[buf]
        starts, stops = w[1:] > w[:-1], w[1:] < w[:-1]
        cuts = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(buf))]
        cuts = cuts[(w[cuts] == 1) & (w[cuts + 1] == 1)]  # texts stand side by side without a separator
        starts[cuts] = stops[cuts] = True
        self.s, self.e = np.flatnonzero(starts), np.flatnonzero(stops)
        self.off = np.concatenate([[0], np.searchsorted(self.s, ends)]).astype(np.int64)
        self.h = _hashes(buf, self.s, self.e) if len(self.s) else np.empty(0, np.uint64)

    def __len__(self) -> int:
        return len(self.s)

    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def rows(self) -> np.ndarray:
        """For each word its row, from 0."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts())

    def joined(self, k: int, keep: np.ndarray | None = None) -> bytes:
        """The words of row k (or those under the mask keep), joined by one space."""
        a, b = self.off[k], self.off[k + 1]
        s, e = self.s[a:b], self.e[a:b]
        if keep is not None:
            s, e = s[keep], e[keep]
        if not len(s):
            return b""
        raw = self.buf[s[0] : e[-1]]
        if keep is None and len(raw) == int((e - s).sum()) + len(s) - 1:
            return np.where(NOT_SPACE[raw], raw, np.uint8(32)).tobytes()
        raw = self.buf.tobytes()
        return b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)])


def words(col: pa.Array, is_word: np.ndarray, lower: bool = False, block: int = _BLOCK) -> Iterator[Words]:
    """The rows of a string column in runs of about `block` bytes of text. A null has no words."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if not len(col):
        return
    off = np.frombuffer(offsets, wide, len(col) + 1, col.offset * np.dtype(wide).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + block, "right")) - 1)
        yield Words(lo, hi, raw[off[lo] : off[hi]], off[lo + 1 : hi + 1] - off[lo], is_word, lower)
        lo = hi


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes (of any row: see inside())."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    acc, have, part, size = None, 0, h.copy(), 1
    while True:
        if n & size:
            if acc is None:
                acc, have = part[: len(h) - size + 1], size
            else:
                m = len(h) - have - size + 1
                acc = acc[:m] * np.uint64(pow(_STEP, size, 1 << 64)) + part[have : have + m]
                have += size
        if have == n:
            return mix(acc + np.uint64(n))
        part = part[:-size] * np.uint64(pow(_STEP, size, 1 << 64)) + part[size:]
        size *= 2


def inside(w: Words, n: int) -> np.ndarray:
    """Which of the runs of n words lie in one row."""
    m = len(w) - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    left = np.repeat(w.off[1:], w.counts())[:m] - np.arange(m)
    return left >= n


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def tidy(rows: Callable) -> Callable:
    """A function over Arrow batches that, when its task ends, gives freed memory back: Spark keeps its Python workers, and
    allocators would keep each one's largest use."""

    @functools.wraps(rows)
    def wrapped(batches):
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return wrapped
