"""A word-level FM-index of one shard of documents, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes. codes: word codes from 1, and 0 at `ends`, where each counts as a symbol of its own; so no
    comparison runs past a document's end. Prefix doubling, which in each round sorts only what is not yet told apart."""
    n = len(codes)
    first = codes.astype(np.int64) + len(ends)
    first[ends] = np.arange(len(ends))
    sa = np.argsort(first, kind="stable")
    key = first[sa]
    rank = np.empty(n, np.int64)
    slots, depth = np.arange(n), 1
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[sa[slots]] = slots[at][group]
        many = np.diff(np.append(at, len(slots))) > 1
        keep = many[group]
        if not keep.any():
            return sa
        slots = slots[keep]
        p = sa[slots]
        key = (rank[p] << 32) | rank[np.minimum(p + depth, n - 1)]
        order = np.argsort(key, kind="stable")
        sa[slots], key = p[order], key[order]
        depth *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, with one bit vector for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.shifts, self.ones, self.zeros = range(bits - 1, -1, -1), [], []
        for shift in self.shifts:
            bit = (seq >> shift) & 1
            count = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(seq) - int(count[-1]))
            up = bit.astype(bool)
            seq = np.concatenate([seq[~up], seq[up]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before position at."""
        start = np.zeros_like(at)
        for shift, ones, zeros in zip(self.shifts, self.ones, self.zeros, strict=True):
            up = (symbol >> shift) & 1 == 1
            a, b = ones[at], ones[start]
            at, start = np.where(up, zeros + a, at - a), np.where(up, zeros + b, start - b)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a position, and how often it stands before."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[at], ones[start]
            up = ones[at + 1] > a
            at, start = np.where(up, zeros + a, at - a), np.where(up, zeros + b, start - b)
            symbol = symbol * 2 + up
        return symbol, at - start


class FMIndex:
    """Words are 64-bit hashes; pieces[k] gives the words of the k-th text."""

    def __init__(self, pieces: list[np.ndarray], sample: int = 16):
        lens = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(lens + 1) - 1
        self.starts = np.concatenate([[0], ends[:-1] + 1]) if len(lens) else np.zeros(0, np.int64)
        self.words, code = np.unique(np.concatenate(pieces), return_inverse=True)
        text = np.zeros(int(ends[-1]) + 1, np.int32)
        body = np.ones(len(text), bool)
        body[ends] = False
        text[body] = code + 1
        sa = suffix_array(text, ends)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.words) + 1))])
        self.bwt = WaveletMatrix(text[sa - 1], max(1, int(len(self.words)).bit_length()))
        kept = sa % sample == 0
        known = np.zeros(len(text), bool)
        known[self.starts] = True
        kept |= known[sa]
        self.sampled = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
        self.samples = sa[kept]

    def search(self, patterns: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows of word hashes, left-aligned) -> the interval of suffixes of each."""
        at = np.minimum(np.searchsorted(self.words, patterns), len(self.words) - 1)
        used = np.arange(patterns.shape[1]) < lens[:, None]
        known = ((self.words[at] == patterns) | ~used).all(axis=1)
        code = at + 1
        lo, hi = np.zeros(len(lens), np.int64), np.where(known, self.before[-1], 0)
        for k in range(patterns.shape[1] - 1, -1, -1):
            i = np.flatnonzero((lens > k) & (lo < hi))
            c = code[i, k]
            lo[i], hi[i] = self.before[c] + self.bwt.rank(c, lo[i]), self.before[c] + self.bwt.rank(c, hi[i])
        return lo, np.maximum(lo, hi)

    def locate(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and position of suffixes: steps back through the text until a sampled one."""
        out, left, steps = np.empty(len(slots), np.int64), np.arange(len(slots)), 0
        while len(left):
            here = self.sampled[slots + 1] > self.sampled[slots]
            out[left[here]] = self.samples[self.sampled[slots[here]]] + steps
            left, slots = left[~here], slots[~here]
            c, r = self.bwt.access(slots)
            slots, steps = self.before[c] + r, steps + 1
        text = np.searchsorted(self.starts, out, "right") - 1
        return text, out - self.starts[text]
