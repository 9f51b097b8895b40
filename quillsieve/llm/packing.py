"""Packing of documents into training sequences along a space-filling curve.

A document is a vector of hashed byte trigrams; a fixed random projection takes it to a few dimensions, and its place on
a Hilbert curve through these is its key. Documents are range-partitioned and sorted by key, so that neighbours on the
curve, which are alike, share sequences. Each task packs its stretch of the curve as one stream of tokens, cut at every
sequence end; what is left over at its end fills sequences of a power of two tokens each, so that nothing is padded.
Equal keys are ordered by document id and split between tasks like others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import small_batches
from ._words import tidy

_DIMS, _BITS, _BUCKETS = 3, 13, 1 << 16
_REACH = 0.06


def _weights() -> np.ndarray:
    """A random sign in each dimension for each bucket, the dimensions side by side in one number, 21 bits each."""
    signs = np.random.default_rng(20_240_601).choice(np.array([-1, 1]), (_DIMS, _BUCKETS))
    return (signs * (1 << 21 * np.arange(_DIMS))[:, None]).sum(axis=0)


def _split(sums: np.ndarray) -> np.ndarray:
    """The sums of the dimensions, which are under 2**20 each."""
    out = []
    for _ in range(_DIMS):
        low = ((sums + (1 << 20)) & ((1 << 21) - 1)) - (1 << 20)
        out.append(low)
        sums = (sums - low) >> 21
    return np.stack(out, axis=1)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows of whole numbers under 2**bits): axes to transposed index, then bits interleaved."""
    x = x.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            flip = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, flip)
            x[i] ^= flip
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        t ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= t
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level) & 1
    return key


def _keys(batches):
    weights = _weights()
    for batch in batches:
        col = batch.column(1)
        if col.null_count:
            col = col.fill_null("")
        _, offsets, data = col.buffers()
        off = np.frombuffer(offsets, np.int32, len(col) + 1, col.offset * 4).astype(np.int64) if len(col) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        at = np.zeros((len(col), _DIMS), np.float64)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 20), "right")) - 1)
            total = np.zeros((hi - lo, _DIMS))
            for a in range(int(off[lo]), int(off[hi]), 1 << 19):  # a long text in parts
                part = raw[a : min(int(off[hi]), a + (1 << 19) + 2)].astype(np.uint32)
                if len(part) < 3:
                    continue
                bucket = ((part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
                ends = np.clip(off[lo : hi + 1] - a, 0, len(bucket))
                stop = np.maximum(np.clip(off[lo + 1 : hi + 1] - a - 2, 0, len(bucket)), ends[:-1])
                sums = np.zeros(len(bucket) + 1, np.int64)
                np.cumsum(weights[bucket], out=sums[1:])
                total += _split(sums[stop] - sums[ends[:-1]])
            at[lo:hi] = total / np.maximum(1, off[lo + 1 : hi + 1] - off[lo:hi] - 2)[:, None]
            lo = hi
        cell = np.clip((at / _REACH + 1) / 2 * (1 << _BITS), 0, (1 << _BITS) - 1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hilbert(cell, _BITS)), batch.column(0), batch.column(1)], names=["key", "doc_id", "text"])


def _pack(path: str, length: int, eod: int):
    def rows(batches):
        from ._tokens import encoder_of

        encoder, base = encoder_of(path), TaskContext.get().partitionId() << 40
        sequence, offset, out = 0, 0, []
        tail: list[tuple[int | None, int, int, np.ndarray, int]] = []  # pieces of the sequence that is not full yet

        def place(doc, start, ids, whole):
            out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole, base + sequence, offset))

        def close():
            """The pieces of the last, not full sequence, in sequences of powers of two."""
            nonlocal sequence, offset
            left = sum(len(p[2]) for p in tail)
            room = 0
            offset = 0
            for doc, start, ids, whole in tail:
                a = 0
                while a < len(ids):
                    if room == 0:
                        room = 1 << (left.bit_length() - 1)
                        left -= room
                        offset = 0
                    n = min(room, len(ids) - a)
                    place(doc, start + a, ids[a : a + n], whole)
                    a, room, offset = a + n, room - n, offset + n
                    if room == 0:
                        sequence += 1

        filled = 0
        for batch in batches:
            names, texts = batch.column(1).to_pylist(), batch.column(2)
            for lo in range(0, len(names), 500):
                for doc, ids in zip(names[lo : lo + 500], encoder.encode(texts.slice(lo, 500).to_pylist()), strict=True):
                    ids = np.append(ids, np.int32(eod))
                    a = 0
                    while a < len(ids):
                        n = min(length - filled, len(ids) - a)
                        tail.append((doc, a, ids[a : a + n], len(ids)))
                        a, filled = a + n, filled + n
                        if filled == length:
                            offset = 0
                            for p in tail:
                                place(*p)
                                offset += len(p[2])
                            tail.clear()
                            sequence, filled = sequence + 1, 0
                if len(out) > 5000:
                    yield table(out)
                    out.clear()
        close()
        if out:
            yield table(out)

    def table(out):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", length: int = 2048, eod: int = 1) -> DataFrame:
    """Pack all documents into sequences of `length` tokens; the last ones of a task hold a power of two tokens.

    Returns for each piece doc_id, start (ids of its document before it), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit numbers), doc_tokens (with the end mark), sequence_id, offset in the sequence (without gaps).

    A null or empty text is the end mark alone. Rows with one id, and null ids, are packed as they are, each for itself.
    An empty table gives no pieces; other columns are ignored. `tokenizer` is the path of a tokenizer file, by default
    that of the 50k byte-level BPE.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    placed = docs.mapInArrow(tidy(_keys), "key long, doc_id long, text string").repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(tidy(_pack(str(tokenizer), length, eod)), schema)
