"""Removal of repeated passages with prefix-partitioned suffix trees.

The suffix tree of all documents' words, down to the depth of a window (20 words), is built in subtrees, each by one task:

1. Suffixes that can't repeat. Of each window the 8-word prefix with the smallest hash stands for it, so that equal windows
   choose alike, and about one suffix in seven is looked at. The Spark shuffle puts the suffixes of one prefix together. A
   prefix with a single text behind it is a leaf: nothing below it can repeat, and its suffixes go no further.
2. Groups. What is left are segments: runs of windows that one prefix stands for, with their words. The segments under each
   prefix are counted. Prefixes with more than `group` of them are lengthened, to 12, 16 and 20 words of the windows, until
   each fits, so that a group is bounded in memory whatever its text. A prefix of a whole window is a node already; its
   first occurrence comes from an aggregation, without a group being held anywhere.
3. Subtrees. A task sorts the suffixes of its groups by their words (by ranks of runs of 1, 2, 4, 8 and 16 words) and takes
   the common prefixes of neighbours. Runs of neighbours with a window in common are the deep internal nodes; a node's
   occurrences, but for the earliest, are repeats, and repeats that follow each other are maximal repeats.

Before each shuffle a task merges its own rows: of suffixes with one prefix, and of segments with equal words, it sends one.
A passage that a third of all documents share so becomes few rows for each task. Documents with equal words are set aside first;
all of a later copy is removed if it has a window at all. Words are compared by 40 bits of their hashes: windows that
differ in one word only are taken as equal with a chance of 2**-40, others less likely yet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch, small_batches
from ._words import NOT_SPACE, grams, inside, mix, signed, tidy, words

_EMPTY = hashlib.sha256(b"").hexdigest()
#: Suffixes (or words of texts) that a task merges at a time, words that subtrees are built of at a time, and rows sent at a time; they bound its memory.
_MERGE, _GROUP, _ROWS = 2_000_000, 1 << 20, 10_000
#: Bytes of a word's hash in a segment, and by how many words a prefix is lengthened.
_WORD, _LONGER = 5, 4


def _text_hashes(w) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's word sequence."""
    at = np.arange(len(w)) - np.repeat(w.off[:-1], w.counts())
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(w.h + np.uint64(c) + at.astype(np.uint64) * np.uint64(k)), dtype=np.uint64)]) for c, k in ((1, 0x9E3779B97F4A7C15), (7, 0xD6E8FEB86659FD93))]
    return tuple(mix(s[w.off[1:]] - s[w.off[:-1]]) for s in sums)


def _chosen(w, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of one text the place of the suffix that stands for it, which is the leftmost smallest hash of a prefix
    inside; which places begin such a window; and the prefixes' hashes."""
    g = grams(w.h, prefix)
    ok = inside(w, window)
    if not ok.any():
        return np.empty(0, np.int64), ok, g
    low = np.uint64((1 << 24) - 1)
    keyed = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)
    span, least, size = window - prefix + 1, keyed, 1
    while size < span:
        step = min(size, span - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    starts = np.flatnonzero(ok)
    at = (least[starts] & low).astype(np.int64)
    at += (starts - at + span - 1) >> 24 << 24  # beyond 2**24 words the low bits wrap
    return at, ok, g


def _scan(window: int, prefix: int):
    """Per task: a row (kind 0) for each document, and suffixes at depth `prefix`, merged: those that repeat here (kind 1)
    and the first of each prefix (kind 2, with how often it occurs)."""

    def rows(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            if not held:
                return
            a, doc, at, same = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, same, a))
            a, doc, at, same = a[order], doc[order], at[order], same[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (same[1:] != same[:-1])  # of copies here, the first stands for all
            a, doc, at, same = a[new], doc[new], at[new], same[new]
            first = np.ones(len(a), bool)
            first[1:] = a[1:] != a[:-1]
            size = np.diff(np.append(np.flatnonzero(first), len(a)))
            many = np.repeat(size > 1, size)
            if many.any():
                yield table(1, doc[many], at[many], a[many], same[many])
            yield table(2, doc[first], at[first], a[first], same[first], (size > 1).astype(np.int32))

        def table(kind, doc, at, a, b, n=None, sha=None):
            m = len(doc)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, kind, np.int8)), pa.array(doc), pa.array(at.astype(np.int32)), pa.array(signed(a)), pa.array(signed(b)), pa.array(np.zeros(m, np.int32) if n is None else n), pa.array(sha, pa.string()) if sha is not None else pa.nulls(m, pa.string())],
                names=["kind", "doc_id", "at", "a", "b", "n", "sha"],
            )

        total = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in words(batch.column(1), NOT_SPACE):
                doc = ids[w.lo : w.hi].astype(np.int64)
                one, two = _text_hashes(w)
                yield table(0, doc, w.counts(), one, two, sha=[hashlib.sha256(w.joined(k)).hexdigest() for k in range(w.hi - w.lo)])
                at, _, g = _chosen(w, window, prefix)
                at = np.unique(at)
                if len(at):
                    row = np.searchsorted(w.off, at, "right") - 1
                    local = at - w.off[row]
                    held.append((g[at], doc[row], local, mix(one[row] ^ mix(local.astype(np.uint64)))))
                    total += len(at)
                    if total >= _MERGE:
                        yield from flush()
                        total = 0
        yield from flush()

    return rows


def _repeated(batches):
    """Suffixes sorted by prefix, text and document: those whose prefix has more than one text behind it. A prefix has a
    row for each task at most, so that the last group can wait for the next batch."""

    def groups(rows, final):
        a, b, n, doc, at = rows
        first = np.ones(len(a), bool)
        first[1:] = a[1:] != a[:-1]
        end = len(a) if final else int(np.flatnonzero(first)[-1])
        text = first.copy()
        text[1:] |= b[1:] != b[:-1]
        group = np.cumsum(first[:end]) - 1
        hit = (np.bincount(group, text[:end]) > 1) | (np.bincount(group, n[:end]) > 0)
        out = text[:end] & hit[group] if end else np.zeros(0, bool)
        return [x[end:] for x in rows], pa.RecordBatch.from_arrays([pa.array(doc[:end][out]), pa.array(at[:end][out])], names=["doc_id", "at"])

    left = None
    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        rows = rows if left is None else [np.concatenate(x) for x in zip(left, rows, strict=True)]
        if len(rows[0]):
            left, out = groups(rows, False)
            yield out
    if left is not None and len(left[0]):
        yield groups(left, True)[1]


def _pick(window: int, prefix: int, w, spots: np.ndarray):
    """Segments of a block of texts: runs of windows that are stood for by one of the spots (sorted places in the block).

    Returns of each segment its first window's place, how many windows it has, and the place of its spot."""
    chosen, ok = _chosen(w, window, prefix)[:2]
    starts = np.flatnonzero(ok)
    i = np.minimum(np.searchsorted(spots, chosen), max(0, len(spots) - 1))
    use = spots[i] == chosen if len(spots) else np.zeros(len(chosen), bool)
    starts, chosen = starts[use], chosen[use]
    if not len(starts):
        return (np.empty(0, np.int64),) * 3
    lead = np.ones(len(starts), bool)
    lead[1:] = (starts[1:] != starts[:-1] + 1) | (chosen[1:] != chosen[:-1])
    first = np.flatnonzero(lead)
    return starts[first], np.diff(np.append(first, len(starts))), chosen[first]


def _packed(h: np.ndarray, place: np.ndarray, size: np.ndarray) -> pa.Array:
    """Of each segment the words, `_WORD` bytes of each one's hash."""
    at = np.repeat(place - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    raw = np.ascontiguousarray(h[at]).view(np.uint8).reshape(-1, 8)[:, :_WORD].tobytes()
    off = np.concatenate([[0], np.cumsum(size * _WORD)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(raw)])


def _unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of all segments, and where each begins."""
    _, offsets, data = col.buffers()
    wide = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(offsets, wide, len(col) + 1, col.offset * np.dtype(wide).itemsize).astype(np.int64)
    out = np.zeros((int(off[-1] - off[0]) // _WORD, 8), np.uint8)
    if len(out):
        out[:, :_WORD] = np.frombuffer(data, np.uint8)[off[0] : off[-1]].reshape(-1, _WORD)
    return out.view(np.uint64).ravel(), (off - off[0]) // _WORD


def _segments(window: int, prefix: int):
    """Documents with the places of their repeated prefixes -> segments under the first prefix (kind 2) with the words of
    their windows. Of segments with equal words here only the earliest goes on; the others are repeats (kind 1)."""

    def rows(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            if not held:
                return
            key, same, doc, at, many, place, h = zip(*held, strict=True)
            base = np.concatenate([[0], np.cumsum([len(x) for x in h])[:-1]])
            place = np.concatenate([p + b for p, b in zip(place, base, strict=True)])
            key, same, doc, at, many, h = (np.concatenate(x) for x in (key, same, doc, at, many, h))
            held.clear()
            order = np.lexsort((at, doc, same))
            lead = np.ones(len(order), bool)
            lead[1:] = same[order][1:] != same[order][:-1]
            first = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            tie = (doc[order] == doc[first]) & (at[order] == at[first])  # a repeated row is not earlier than itself
            parts = [(kind, i[a : a + _ROWS]) for kind, i in ((1, order[~tie]), (2, order[lead])) for a in range(0, len(i), _ROWS)]
            for kind, i in parts:
                size = many[i] + window - 1 if kind == 2 else np.zeros(len(i), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind, np.int8)), pa.array(signed(key[i])), pa.array(doc[i]), pa.array(at[i].astype(np.int32)), pa.array(many[i].astype(np.int32)), _packed(h, place[i], size)], names=["kind", "key", "doc_id", "at", "many", "words"])

        total = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            places = batch.column(2)
            for w in words(batch.column(1), NOT_SPACE):
                part = places.slice(w.lo, w.hi - w.lo)
                lens = part.value_lengths().to_numpy(zero_copy_only=False)
                spots = np.unique(part.flatten().to_numpy(zero_copy_only=False) + np.repeat(w.off[:-1], lens))
                place, many, spot = _pick(window, prefix, w, spots)
                if not len(place):
                    continue
                row = np.searchsorted(w.off, place, "right") - 1
                sums = np.concatenate([[np.uint64(0)], np.cumsum(grams(w.h, window), dtype=np.uint64)])
                same = mix(sums[place + many] - sums[place] + many.astype(np.uint64))  # windows follow each other, so their sum tells a segment
                held.append((grams(w.h, prefix)[spot], same, ids[w.lo : w.hi][row], place - w.off[row], many, place, w.h))
                total += len(w.h)
                if total >= _MERGE:
                    yield from flush()
                    total = 0
        yield from flush()

    return rows


def _lengthened(window: int, depth: int):
    """Segments under prefixes that are too frequent -> their windows one by one, under their first `depth` words."""

    def rows(batches):
        for batch in batches:
            col = {n: batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "at", "many", "words")}
            h, off = _unpacked(col["words"])
            many = col["many"].to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(many)), many)
            k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            place = off[:-1][row] + k
            key = grams(h, depth)[place] if len(place) else np.empty(0, np.uint64)
            at = col["at"].to_numpy(zero_copy_only=False)[row] + k.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(col["doc_id"].to_numpy(zero_copy_only=False)[row]), pa.array(at), pa.array(np.ones(len(row), np.int32)), _packed(h, place, np.full(len(row), window))], names=["key", "doc_id", "at", "many", "words"])

    return rows


def _ranks(h: np.ndarray, window: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of the runs of 1, 2, 4, ... words at each place, up to half a window at least: equal runs have equal ranks."""
    out, size = [(1, np.unique(h, return_inverse=True)[1].astype(np.int64))], 1
    while size * 2 <= window:
        r = out[-1][1]
        pair = np.full(len(r), -1, np.int64)
        pair[: len(r) - size] = r[: len(r) - size] * (int(r.max()) + 2) + r[size:] + 1 if len(r) > size else 0
        size *= 2
        out.append((size, np.unique(pair, return_inverse=True)[1].astype(np.int64)))
    return out


def _common_prefix(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """How many words the suffixes at a and b have in common, `window` at most."""
    depth = np.zeros(len(a), np.int64)
    for size, r in reversed(ranks):
        fits = np.flatnonzero(depth + size <= window)
        d = depth[fits]
        depth[fits] = d + size * (r[a[fits] + d] == r[b[fits] + d])
    return depth


def _subtrees(window: int):
    """Segments sorted by prefix -> runs of windows (doc_id, at, many) that are later occurrences of a deep internal node.

    Suffixes (each window of each segment) are sorted by their words and, among equal ones, by document and place. Common
    prefixes of neighbours make the tree: a maximal run of neighbours with `window` words in common is an internal node of
    that depth or more, its suffixes are the node's occurrences. Groups of whole prefixes are taken together up to
    `_GROUP` words."""

    def build(key, doc, at, many, h, off):
        row = np.repeat(np.arange(len(many)), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        place, d, p = off[:-1][row] + k, doc[row], at[row] + k
        ranks = _ranks(h, window)
        size, top = ranks[-1]
        order = np.lexsort((p, d, *([top[place + window - size]] if size < window else []), top[place]))
        s = place[order]
        deep = np.zeros(len(s), bool)
        deep[1:] = _common_prefix(ranks, s[:-1], s[1:], window) >= window
        first = order[np.maximum.accumulate(np.where(deep, 0, np.arange(len(s))))]
        later = np.zeros(len(s), bool)
        later[order] = deep & ((d[order] != d[first]) | (p[order] != p[first]))
        i = np.flatnonzero(later)
        lead = np.ones(len(i), bool)
        lead[1:] = (i[1:] != i[:-1] + 1) | (row[i][1:] != row[i][:-1])
        first = np.flatnonzero(lead)
        return pa.RecordBatch.from_arrays([pa.array(d[i[first]]), pa.array(p[i[first]].astype(np.int32)), pa.array(np.diff(np.append(first, len(i))).astype(np.int32))], names=["doc_id", "at", "many"])

    def rows(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def joined():
            cols = [np.concatenate(x) for x in zip(*[r[:5] for r in held], strict=True)]
            size = np.concatenate([np.diff(r[5]) for r in held])
            held.clear()
            return [*cols, np.concatenate([[0], np.cumsum(size)])]

        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, at, many = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            h, off = _unpacked(batch.column(4))
            held.append((key, doc, at.astype(np.int64), many.astype(np.int64), h, off))
            total += len(h)
            if total >= _GROUP:
                key, doc, at, many, h, off = joined()
                end = int(np.searchsorted(key, key[-1]))  # the last prefix may go on
                if end:
                    yield build(key[:end], doc[:end], at[:end], many[:end], h[: off[end]], off[: end + 1])
                held.append((key[end:], doc[end:], at[end:], many[end:], h[off[end] :], off[end:] - off[end]))
                total = len(held[0][4])
        if held:
            yield build(*joined())

    return rows


def _cut(window: int, text: bool):
    """Documents with the runs of their repeated windows: what is left of each."""

    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for w in words(batch.column(1), NOT_SPACE):
                part = batch.column(2).slice(w.lo, w.hi - w.lo)
                cuts = np.concatenate([[0], np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))])
                begin, many = (part.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "many"))
                for k in range(w.hi - w.lo):
                    at, end = (x[cuts[k] : cuts[k + 1]] for x in (begin, begin + many - 1 + window))
                    n = int(w.off[k + 1] - w.off[k])
                    at, end = at[end <= n], end[end <= n]
                    delta = np.zeros(n + 1, np.int64)
                    np.add.at(delta, at, 1)
                    np.add.at(delta, end, -1)
                    keep = np.cumsum(delta[:-1]) == 0
                    left = w.joined(k, keep)
                    spans = np.flatnonzero(np.diff(np.concatenate([[0], ~keep, [0]]))).reshape(-1, 2)
                    yield ids[w.lo + k], n, n - int(keep.sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if text else None, spans.tolist()

    def batched(batches):
        out = []
        for row in rows(batches):
            out.append(row)
            if len(out) == 500:
                yield table(out)
                out = []
        if out:
            yield table(out)

    def table(out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return batched


def _later_windows(parts: DataFrame, window: int, prefix: int, group: int, scratch: Scratch) -> DataFrame:
    """Documents with the places of their repeated prefixes -> runs of windows (doc_id, at, many) that also start earlier."""
    found = scratch.save(parts.mapInArrow(tidy(_segments(window, prefix)), "kind byte, key long, doc_id long, at int, many int, words binary"), "segments")
    rows = found.where("kind = 2").select("key", "doc_id", "at", "many", "words")
    out, groups, depth = found.where("kind = 1").select("doc_id", "at", "many"), [], prefix
    while True:
        frequent = scratch.save(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group).select("key"), f"frequent-{depth}")
        if frequent.isEmpty():
            groups.append(rows)
            break
        groups.append(rows.join(frequent.hint("merge"), "key", "left_anti"))
        over = rows.join(frequent.hint("merge"), "key", "left_semi").select("doc_id", "at", "many", "words")
        depth = min(window, depth + _LONGER)
        rows = scratch.save(over.mapInArrow(tidy(_lengthened(window, depth)), "key long, doc_id long, at int, many int, words binary"), f"segments-{depth}")
        if depth == window:  # each prefix is a node itself, and its first occurrence is found by a partial aggregation
            first = scratch.save(rows.groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("first")), "nodes")
            again = rows.select("key", "doc_id", "at", "many").join(first.hint("merge"), "key")
            out = out.unionByName(again.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at"))).select("doc_id", "at", "many"))
            break
    whole = groups[0]
    for more in groups[1:]:
        whole = whole.unionByName(more)
    whole = whole.repartition("key").sortWithinPartitions("key")
    return out.unionByName(whole.mapInArrow(tidy(_subtrees(window)), "doc_id long, at int, many int"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, prefix: int = 8, group: int = 1 << 13, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window whose word sequence also starts earlier.

    Words are maximal runs of characters other than ASCII white space. Earlier means a smaller document id, or the same
    document and an earlier start. Windows are judged on the input. Returns doc_id, n_words, n_removed, kept_sha256,
    spans (the maximal repeats removed, as [first word, last word + 1] pairs; null where nothing or all is removed)
    and, if asked for, kept: the words left, joined by one space where any was removed, else the text as it is.

    A null or empty text has no words. Documents under `window` words are left alone. Rows with one id and one text are
    the same document: none is earlier than the other. Different texts under one id are documents of their own, in order of
    their SHA-256; `kept` tells which is which. Rows with a null id are left alone, and nothing repeats them.
    An empty table gives an empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "repeats")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    found = scratch.save(known.mapInArrow(tidy(_scan(window, prefix)), "kind byte, doc_id long, at int, a long, b long, n int, sha string"), "scan")
    one = found.where("kind = 0").selectExpr("doc_id", "at n_words", "a", "b", "sha")
    first = scratch.save(one.groupBy("a", "b").agg(F.min("doc_id").alias("first")), "first")
    one = scratch.save(one.join(first.hint("merge"), ["a", "b"]).selectExpr("doc_id", "cast(n_words as long) n_words", "sha", "first"), "docs")

    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("a", "b") for f in (F.min, F.max)]
    if not found.where("kind = 0").groupBy("doc_id").agg(*ends).where("min_a <> max_a or min_b <> max_b").isEmpty():
        scratch.drop("scan", "first", "docs")
        return _numbered(docs, scratch, window, prefix, group, with_text)
    scratch.release()
    local = found.where("kind = 1").select("doc_id", "at")
    shared = found.where("kind = 2").select("a", "b", "n", "doc_id", "at").repartition("a").sortWithinPartitions("a", "b", "doc_id").mapInArrow(tidy(_repeated), "doc_id long, at int")
    spots = local.unionByName(shared).distinct().groupBy("doc_id").agg(F.collect_list("at").alias("spots"))
    copies = one.where("doc_id <> first").select("doc_id").distinct()
    spots = scratch.save(spots.join(copies.hint("merge"), "doc_id", "left_anti"), "spots")
    scratch.drop("scan")
    scratch.release()
    parts = scratch.save(known.join(spots.hint("merge"), "doc_id"), "parts")
    scratch.release()
    runs = _later_windows(parts, window, prefix, group, scratch).groupBy("doc_id").agg(F.collect_set(F.struct("at", "many")).alias("runs"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<array<int>>"
    cut = parts.select("doc_id", "text").join(runs.hint("merge"), "doc_id").mapInArrow(tidy(_cut(window, with_text)), schema).where("n_removed > 0")

    copy = (F.col("doc_id") != F.col("first")) & (F.col("n_words") >= window)
    whole = one.withColumn("copy", copy)
    cut = scratch.save(cut, "cut")
    scratch.drop(*[n for n in scratch.names if n not in ("docs", "cut")])
    scratch.release()
    cut = cut.select("doc_id", F.struct("n_removed", "kept_sha256", "kept", "spans", "n_words").alias("cut")).dropDuplicates(["doc_id"])
    out = whole.join(cut.hint("merge"), "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut.n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("cut.kept_sha256", "sha")).alias("kept_sha256"),
        F.when(~F.col("copy"), F.col("cut.spans")).alias("spans"),
        *([F.when(F.col("copy"), F.lit("")).otherwise(F.col("cut.kept")).alias("kept")] if with_text else []),
    )
    return out.unionByName(_unnamed(docs, window, with_text))


def _numbered(docs: DataFrame, scratch: Scratch, window: int, prefix: int, group: int, with_text: bool) -> DataFrame:
    """remove_repeats where some id stands for several texts: each text of an id gets a number, in order of ids and hashes."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    keys = docs.where("doc_id is not null").select("doc_id", digest).distinct().repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    keys = scratch.save(keys.withColumn("number", F.monotonically_increasing_id()), "numbers")
    rows = docs.withColumn("digest", digest).join(keys.hint("merge"), ["doc_id", "digest"], "left")
    out = remove_repeats(rows.select(F.col("number").alias("doc_id"), "text"), window=window, prefix=prefix, group=group, with_text=with_text)
    out = out.withColumnRenamed("doc_id", "number").join(keys.select("number", "doc_id").hint("merge"), "number", "left").drop("number")
    return out.select("doc_id", *[c for c in out.columns if c != "doc_id"])


def _unnamed(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Rows with a null id."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<array<int>>"
    out = docs.where("doc_id is null").withColumn("runs", F.array().cast("array<struct<at:int,many:int>>")).mapInArrow(tidy(_cut(window, False)), schema)
    return out.selectExpr("doc_id", "n_words", "n_removed", "kept_sha256", "cast(null as array<array<int>>) spans", *(["cast(null as string) kept"] if with_text else []))
