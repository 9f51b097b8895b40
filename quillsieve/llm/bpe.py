"""Byte-level BPE encoding and decoding of whole texts, the merges by a segment tree over the ranks of adjacent pairs.

A tokenizer file gives the vocabulary and the order of merges. A text is cut at special tokens and into pre-tokens, and each
distinct pre-token of a task is merged once: the leaves of its tree are its adjacent pairs, as rank and place in one number,
and each node is the least of its two children, so that the root is the leftmost pair of lowest rank. A merge changes three
leaves (the pair itself, the one before and the one that is swallowed) and the nodes above them, until the root has no pair.

Short pre-tokens are merged many at once, the trees being rows of an array; a long one (a run of letters without a space can
be as long as its text) has a tree of its own and takes n log n steps. No shuffle: each text is coded where it is read.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType
from tokenizers.pre_tokenizers import ByteLevel

from ._scratch import small_batches
from ._tokens import _LETTER, _NUMBER, _SIGN, _SPACE, Encoder, pretokens
from ._words import _POW, tidy

#: A node without a pair. Ranks stand above the lowest 32 bits, places in them.
_NONE = 1 << 62
#: Pre-tokens of up to so many bytes are merged side by side.
_SHORT = 64
# White space in Unicode.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


#: The class of code points that this Python's Unicode tables don't assign; the library's may be newer.
_UNASSIGNED = 4


@functools.cache
def unicode_classes() -> np.ndarray:
    """The class of each code point: letter, number, white space, sign or unassigned."""
    of = {"L": _LETTER, "N": _NUMBER}
    classes = np.fromiter((_UNASSIGNED if (k := unicodedata.category(chr(c))) == "Cn" else of.get(k[0], _SIGN) for c in range(0x110000)), np.int8, 0x110000)
    classes[_WHITE] = _SPACE
    return classes


def byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class Merges:
    """Vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, pre = whole["model"], whole["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or whole["normalizer"]:
            raise ValueError(f"{path} is no byte-level BPE tokenizer without a normalizer and a prefix space")
        added = whole["added_tokens"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has special tokens that reach beyond their own text")
        self.special = {t["content"]: t["id"] for t in added}
        vocabulary, signs = model["vocab"], byte_signs()
        self.start = np.array([vocabulary[c] for c in signs], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys, first = np.unique(left << 32 | right, return_index=True)
        self.keys, self.ranks = keys, first.astype(np.int64)
        self.rank = dict(zip(keys.tolist(), first.tolist(), strict=True))
        back = {c: b for b, c in enumerate(signs)}
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        known = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in (vocabulary | self.special).items()}
        words = [known.get(i, b"") for i in range(size)]
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(w) for w in words])])

    def _leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.ranks[k] << 32 | at, _NONE)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words])
        for bits in range(_SHORT.bit_length()):
            some = np.flatnonzero((sizes > (1 << bits) // 2) & (sizes <= 1 << bits))
            for a in range(0, len(some), 4096):
                part = some[a : a + 4096]
                for k, ids in zip(part.tolist(), self._rows([words[k] for k in part], 1 << bits), strict=True):
                    out[k] = ids
        for k in np.flatnonzero(sizes > _SHORT).tolist():
            out[k] = self._long(words[k])
        return out

    def _rows(self, words: list[bytes], width: int) -> list[list[int]]:
        """Words of up to `width` bytes, a power of two: a tree in each row, node 1 its root, leaf i at width + i."""
        n, size = len(words), np.array([len(w) for w in words])
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = self.start[np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)]
        ids[np.arange(width + 1) >= size[:, None]] = -1
        tree = np.full((n, 2 * width), _NONE, np.int64)
        place = np.broadcast_to(np.arange(width), (n, width))
        tree[:, width:] = np.where(ids[:, 1:] >= 0, self._leaf(ids[:, :-1], np.maximum(ids[:, 1:], 0), place), _NONE)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        after = np.tile(np.arange(1, width + 1), (n, 1))
        after[after >= size[:, None]] = width  # column `width` of ids is none
        before = np.tile(np.arange(-1, width), (n, 1))
        rows = np.arange(n)
        while len(rows := rows[tree[rows, 1] < _NONE]):
            root = tree[rows, 1]
            at = root & 0xFFFFFFFF
            gone = after[rows, at]
            follows = after[rows, gone]
            ids[rows, at] = self.made[root >> 32]
            ids[rows, gone] = -1
            after[rows, at] = follows
            before[rows, follows] = at
            self._put(tree, width, rows, gone, np.full(len(rows), _NONE))
            self._put(tree, width, rows, at, self._pair(ids, rows, at, follows))
            r = np.flatnonzero(before[rows, at] >= 0)
            self._put(tree, width, rows[r], before[rows[r], at[r]], self._pair(ids, rows[r], before[rows[r], at[r]], at[r]))
        kept = ids[:, :width] >= 0
        return [x.tolist() for x in np.split(ids[:, :width][kept], np.cumsum(kept.sum(axis=1))[:-1])]

    def _pair(self, ids: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        right = ids[rows, b]
        return np.where(right >= 0, self._leaf(ids[rows, a], np.maximum(right, 0), a), _NONE)

    @staticmethod
    def _put(tree: np.ndarray, width: int, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        k = leaf + width
        tree[rows, k] = value
        for _ in range(width.bit_length() - 1):
            value = np.minimum(value, tree[rows, k ^ 1])
            k = k >> 1
            tree[rows, k] = value

    def _long(self, word: bytes) -> list[int]:
        """One word by a tree of its own."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        start = self.start[np.frombuffer(word, np.uint8)]
        level = np.full(width, _NONE, np.int64)
        level[: n - 1] = self._leaf(start[:-1], start[1:], np.arange(n - 1))
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        tree = [_NONE, *np.concatenate(levels[::-1]).tolist()]
        ids, after, before = start.tolist(), [*range(1, n + 1)], [*range(-1, n - 1)]
        made, rank = self.made.tolist(), self.rank

        def put(leaf: int, value: int) -> None:
            k = leaf + width
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                value = value if value < other else other
                k >>= 1
                if tree[k] == value:  # nothing above changes
                    break
                tree[k] = value

        def pair(a: int, b: int) -> int:
            r = rank.get(ids[a] << 32 | ids[b])
            return _NONE if r is None else r << 32 | a

        while tree[1] < _NONE:
            at, gone = tree[1] & 0xFFFFFFFF, after[tree[1] & 0xFFFFFFFF]
            ids[at], ids[gone] = made[tree[1] >> 32], -1
            after[at] = follows = after[gone]
            put(gone, _NONE)
            put(at, pair(at, follows) if follows < n else _NONE)
            if follows < n:
                before[follows] = at
            if before[at] >= 0:
                put(before[at], pair(before[at], at))
        return [i for i in ids if i >= 0]


class TreeEncoder(Encoder):
    """Whole texts to ids: pre-tokens by numpy, each distinct one merged by trees."""

    def __init__(self, path: str, keep: int = 300_000):
        self.merges = Merges(path)
        self.classes = unicode_classes()
        self.split = ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.special = list(self.merges.special)
        self.keep = keep
        self._clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return self.merges.merge([t.encode() for t in texts])

    def _whole(self, text: str) -> np.ndarray:
        """A text with special tokens, or a long one: in parts between special tokens and at blanks, where a pre-token begins anyway."""
        by_length = sorted(self.special, key=len, reverse=True)
        out = []
        for part in re.split("(" + "|".join(map(re.escape, by_length)) + ")", text) if by_length else [text]:
            if part in self.merges.special:
                out.append(np.array([self.merges.special[part]], np.int32))
            else:
                out += [x for a, b in self._cuts(part) for x in ([self._unbroken(part[a:b])] if b - a > len(_POW) // 2 else self.encode([part[a:b]]))]
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def _cuts(self, text: str) -> list[tuple[int, int]]:
        blank, cuts = re.compile(r"(?<=\S) (?=\S)"), [0]
        while found := blank.search(text, cuts[-1] + len(_POW) // 4):
            cuts.append(found.start())
        return list(zip(cuts, [*cuts[1:], len(text)], strict=True))

    def _assign(self, cp: np.ndarray) -> None:
        """Take the classes of unassigned code points from how the library cuts them off a letter and a number."""
        for c in np.unique(cp[self.classes[cp] == _UNASSIGNED]).tolist():
            self.classes[c] = _LETTER if len(self.split(f"a{chr(c)}")) == 1 else _NUMBER if len(self.split(f"1{chr(c)}")) == 1 else _SIGN

    def _run(self, texts: list[str], run: list[int], out: list[np.ndarray]) -> None:
        for k in run:
            if not texts[k].isascii():
                self._assign(np.frombuffer(texts[k].encode("utf-32-le"), np.uint32))
        super()._run(texts, run, out)

    def _unbroken(self, text: str) -> np.ndarray:
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self._assign(cp)
        s = pretokens(cp, np.array([0, len(cp)]), self.classes)
        parts = [text[a:b] for a, b in zip(s.tolist(), [*s[1:].tolist(), len(text)], strict=True)]
        distinct = dict.fromkeys(parts)
        known = dict(zip(distinct, self._ids(list(distinct)), strict=True))
        return np.array([i for p in parts for i in known[p]], np.int32)


_encoders: dict[str, TreeEncoder] = {}


def _encoder(path: str) -> TreeEncoder:
    """The encoder that the tasks of this process share, one after another."""
    if path not in _encoders:
        _encoders[path] = TreeEncoder(path)
    return _encoders[path]


def _added(df: DataFrame, column: str, kind) -> StructType:
    return StructType([*[f for f in df.schema.fields if f.name != column], StructField(column, kind)])


def _sums(column: pa.Array) -> np.ndarray:
    """Where the bytes of each row would begin, and end, if the rows stood side by side."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])


def _binary(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of bytes that stand side by side."""
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with their text's ids in a column `ids`: unsigned 32-bit numbers in little-endian order, as binary.

    `path` is a byte-level BPE tokenizer file that all executors can read. The ids are those that the tokenizers library gives
    without special tokens of its own; a special token's string in a text becomes that token. A null or empty text has no ids
    (empty binary). Other columns, repeated rows and null keys stay as they are; a column named as `ids` is replaced; an
    empty table gives an empty one. A long text takes n log n steps."""
    small_batches(df.sparkSession)
    schema = _added(df, ids, BinaryType())
    names = [f.name for f in schema.fields if f.name != ids]

    @tidy
    def rows(batches):
        encoder = _encoder(path)
        for batch in batches:
            texts = batch.column(text)
            lo, size = 0, _sums(texts)
            while lo < len(texts):  # a few megabytes of text at a time
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + (4 << 20), "right")) - 1)
                found = encoder.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                ends = np.concatenate([[0], np.cumsum([4 * len(x) for x in found])])
                column = _binary(np.concatenate(found).astype("<u4").view(np.uint8) if ends[-1] else np.empty(0, np.uint8), ends, pa.binary())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], column], [*names, ids])
                lo = hi

    return df.mapInArrow(rows, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the text of their ids (as of encode_texts) in a column `text`, special tokens included.

    Bytes that are no UTF-8, as after ids cut off within a character, become U+FFFD. Null ids give a null text; ids outside
    the vocabulary give nothing. Other columns stay; an empty table gives an empty one."""
    schema = _added(df, text, StringType())
    names = [f.name for f in schema.fields if f.name != text]

    @tidy
    def rows(batches):
        merges = _encoder(path).merges
        for batch in batches:
            lists = batch.column(ids)
            lo, sums = 0, _sums(lists) // 4
            while lo < len(lists):
                hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + (1 << 20), "right")) - 1)
                some = lists.slice(lo, hi - lo)
                flat = np.frombuffer(b"".join([x or b"" for x in some.to_pylist()]), "<u4").astype(np.int64)
                flat = np.where(flat < len(merges.ends) - 1, flat, len(merges.ends) - 1)
                ends = np.append(merges.ends, merges.ends[-1])
                size = ends[flat + 1] - ends[flat]
                stop = np.concatenate([[0], np.cumsum(size)])
                spot = np.repeat(ends[flat] - stop[:-1], size) + np.arange(stop[-1])
                raw, cut = merges.bytes[spot], stop[sums[lo : hi + 1] - sums[lo]]
                column = _binary(raw, cut, pa.string())
                try:
                    column.validate(full=True)
                except pa.ArrowInvalid:
                    column = pa.array([raw[a:b].tobytes().decode(errors="replace") for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string())
                if some.null_count:
                    column = pa.array([None if x is None else y for x, y in zip(some.to_pylist(), column.to_pylist(), strict=True)], pa.string())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], column], [*names, text])
                lo = hi

    return df.mapInArrow(rows, schema)


def count_ids(ids: str = "ids"):
    """How many ids a column of encode_texts holds."""
    return (F.octet_length(ids) / 4).cast("long")
