"""Token ids of many texts by a byte-level BPE tokenizer file.

BPE never looks past a pre-token (a word with the blank before it, a number, a run of signs or of white space), and the
same pre-tokens come again and again. So a numpy pass cuts the texts into pre-tokens, and the tokenizer is asked once for
each distinct one. A text with characters that this pass doesn't know goes to the tokenizer as a whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from ._words import _INV, _POW, mix

#: Code points below this have had their classes since early Unicode versions.
_KNOWN = 0x530
_SPACE, _LETTER, _NUMBER, _SIGN = range(4)
_WHITE = {*range(9, 14), 32, 0x85, 0xA0}
_CLASS = np.array([_SPACE if c in _WHITE else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _SIGN) for c in range(_KNOWN)], np.int8)


def pretokens(cp: np.ndarray, off: np.ndarray, classes: np.ndarray = _CLASS) -> np.ndarray:
    """Starts of the pre-tokens of texts that stand side by side in cp, the k-th from off[k] to off[k + 1]; classes: of code points."""
    n = len(cp)
    kind = classes[cp]
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    white = kind == _SPACE
    # the last of several white characters before other text begins anew; a blank joins what follows
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    start[:n] |= last
    blank = np.flatnonzero(last & (cp == 32))
    start[blank + 1] = False
    # contractions
    i = np.flatnonzero((cp == 39) & start[:n])
    i = i[i + 1 < n]
    i = i[(kind[i + 1] == _LETTER) & ~first[i + 1]]
    a = cp[i + 1]
    b = cp[np.minimum(i + 2, n - 1)]
    two = (i + 2 < n) & ~first[np.minimum(i + 2, n)] & (((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108)))
    one = np.isin(a, [115, 116, 109, 100])
    for j, size in ((i[one], 2), (i[two], 3)):
        start[j + 1] = False
        start[np.minimum(j + size, n)] = True
    return np.flatnonzero(start[:n])


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder that the tasks of this process share, one after another."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Not shared between threads. Keeps the ids of up to `keep` pre-tokens."""

    #: Classes of the code points that the numpy pass knows.
    classes = _CLASS

    def __init__(self, path: str, keep: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep = keep
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.at, self.size = np.empty(self.keep * 2, np.int64), np.empty(self.keep * 2, np.int64)
        # by the low bits of a hash: a hash with these bits, and its slot; the dictionary has the rest
        self.near, self.near_slot = np.full(1 << 20, ~np.uint64(0)), np.zeros(1 << 20, np.int32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of pre-tokens; those without a white-space character inside or alone are asked for in lines, many at once."""
        out: list[list[int]] = [[]] * len(texts)
        plain = [k for k, t in enumerate(texts) if len(self.line) == 1 and not _WHITE.intersection(map(ord, t[1:])) and (t[0] == " " and len(t) > 1 or ord(t[0]) not in _WHITE)]
        for a in range(0, len(plain), 2000):
            some = plain[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([texts[k] for k in some])], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(ids == self.line[0])
            if len(cuts) != len(some) - 1:
                plain = plain[:a]
                break
            for k, x in zip(some, np.split(ids, cuts), strict=True):
                out[k] = (x[1:] if k != some[0] else x).tolist()
        done = set(plain)
        rest = [k for k in range(len(texts)) if k not in done]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        k = len(self.slot)
        if k + len(texts) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.empty(len(texts) + len(x), np.int64)]) for x in (self.at, self.size))
        found = self._ids(texts)
        sizes = np.array([len(x) for x in found], np.int64)
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(total, len(self.flat)), np.int32)])
        self.flat[self.used : self.used + total] = np.concatenate([np.array(x, np.int32) for x in found]) if total else []
        self.at[k : k + len(texts)] = self.used + np.cumsum(sizes) - sizes
        self.size[k : k + len(texts)] = sizes
        self.used += total
        self.slot.update(zip(hashes, range(k, k + len(texts)), strict=True))

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text that the numpy pass can't take."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int32) of each text."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        run, size = [], 0
        for k, t in enumerate(texts):
            if not t:
                continue
            if len(t) > len(_POW) // 2 or any(s in t for s in self.special) or not t.isascii() and ord(max(t)) >= len(self.classes):
                out[k] = self._whole(t)
                continue
            run.append(k)
            size += len(t)
            if size > len(_POW) // 2:
                self._run(texts, run, out)
                run, size = [], 0
        if run:
            self._run(texts, run, out)
        return out

    def _run(self, texts: list[str], run: list[int], out: list[np.ndarray]) -> None:
        whole = "".join([texts[k] for k in run])
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        off = np.concatenate([[0], np.cumsum([len(texts[k]) for k in run])])
        s = pretokens(cp, off, self.classes)
        e = np.append(s[1:], len(cp))
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * _POW[: len(cp)], out=sums[1:])
        h = mix((sums[e] - sums[s]) * _INV[s] ^ (e - s).astype(np.uint64))
        if len(self.slot) > self.keep:
            self._clear()
        place = (h & np.uint64(len(self.near) - 1)).astype(np.int64)
        slots = self.near_slot[place].astype(np.int64)
        far = np.flatnonzero(self.near[place] != h)
        if len(far):
            distinct, where, code = np.unique(h[far], return_index=True, return_inverse=True)
            where = far[where]
            keys = distinct.tolist()
            new = [k for k, x in enumerate(keys) if x not in self.slot]
            if new:
                self._learn([keys[k] for k in new], [whole[s[where[k]] : e[where[k]]] for k in new])
            known = np.array([self.slot[x] for x in keys], np.int64)
            slots[far] = known[code]
            self.near[place[where]], self.near_slot[place[where]] = distinct, known
        size = self.size[slots]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[slots] - ends + size, size) + np.arange(ends[-1])]
        cut = np.concatenate([[0], ends])[np.searchsorted(s, off)]
        for k, a, b in zip(run, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out[k] = ids[a:b]
