"""Benchmark decontamination with an FM-index for each shard of the training documents.

Each task cuts its documents into shards of a bounded number of words and indexes each; test windows are found by
backward search through the ranks of a wavelet matrix, located by sampled suffix positions, and merged to spans. Nothing
is shuffled. The windows of the test items go to the tasks in blocks of a bounded number of words.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._fm_index import FMIndex
from ._scratch import small_batches
from ._words import LETTERS_DIGITS, tidy, words


def _item_words(batches):
    for batch in batches:
        names = batch.column(0).to_pylist()
        for w in words(batch.column(1), LETTERS_DIGITS, lower=True):
            rows = [(names[w.lo + k], w.h[w.off[k] : w.off[k + 1]].tobytes()) for k in range(w.hi - w.lo) if w.off[k + 1] > w.off[k]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["item", "words"])


def _patterns(items: list[tuple[str, bytes]], window: int):
    """Distinct windows, left-aligned in a matrix, their lengths, and the items of each."""
    found: dict[bytes, set[str]] = {}
    for item, raw in items:
        n = len(raw) // 8
        for i in range(max(1, n - window + 1)):
            found.setdefault(raw[8 * i : 8 * (i + window)], set()).add(item)
    lens = np.array([len(x) // 8 for x in found], np.int64)
    rows = np.frombuffer(b"".join(x.ljust(8 * window, b"\0") for x in found), np.uint64).reshape(len(found), window)
    return rows, lens, [sorted(x) for x in found.values()]


def _hits(shared, window: int, shard: int, again: bool):
    """For each document the spans of words inside occurrences, and the items that occur, added to those that an earlier
    block of items has given. The text is handed on if another block follows."""

    def rows(batches):
        patterns, lens, owners = shared.value
        ids, texts, counts, marks, items, pieces, place = [], [], [], [], [], [], []

        def look():
            """Index the pieces at hand and note what occurs in them."""
            if pieces and len(lens):
                index = FMIndex(pieces)
                lo, hi = index.search(patterns, lens)
                many = hi - lo
                which = np.repeat(np.arange(len(lo)), many)
                piece, at = index.locate(np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many))
                where = np.array(place, np.int64)
                doc, at = where[piece, 0], at + where[piece, 1]
                order = np.argsort(doc, kind="stable")
                doc, at, which = doc[order], at[order], which[order]
                cuts = np.append(np.flatnonzero(np.diff(np.append(-1, doc))), len(doc))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    marks[doc[a]].append((at[a:b], at[a:b] + lens[which[a:b]]))
                    for p in np.unique(which[a:b]):
                        items[doc[a]].update(owners[p])
            pieces.clear()
            place.clear()

        def table():
            spans = [_merged(n, m) for n, m in zip(counts, marks, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([_without(t, x) for t, x in zip(texts, spans, strict=True)], pa.string())],
                names=["doc_id", "text", "n_words", "spans", "items", "kept"],
            )

        total = 0
        for batch in batches:
            names, spans, before = (batch.column(k).to_pylist() for k in (0, 3, 4))
            for w in words(batch.column(1), LETTERS_DIGITS, lower=True):
                for k in range(w.hi - w.lo):
                    had = np.array(spans[w.lo + k] or [], np.int64).reshape(-1, 2)
                    h = w.h[w.off[k] : w.off[k + 1]]
                    for x, y in ((ids, names[w.lo + k]), (texts, batch.column(1)[w.lo + k].as_py() if again else None), (counts, len(h)), (marks, [(had[:, 0], had[:, 1])] if len(had) else []), (items, set(before[w.lo + k] or []))):
                        x.append(y)
                    for a in range(0, len(h), shard):  # a long document is cut; what lies over a cut is in the overlap
                        pieces.append(h[a : a + shard + window - 1].copy())
                        place.append((len(ids) - 1, a))
                        total += len(pieces[-1])
                        if total >= shard:
                            look()
                            total = 0
                    if total == 0 and len(ids) >= 100 or len(ids) >= 20_000:
                        look()
                        yield table()
                        total = 0
                        for x in (ids, texts, counts, marks, items):
                            x.clear()
        if ids:
            look()
            yield table()

    return rows


def _without(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the words of the spans and what stands between them; null where there are none."""
    if not spans or text is None:
        return None
    raw, parts, at = text.encode(), [], 0
    (w,) = words(pa.array([text]), LETTERS_DIGITS, lower=True)
    for a, b in spans:
        parts.append(raw[at : int(w.s[a])])
        at = int(w.e[b - 1])
    return b"".join([*parts, raw[at:]]).decode()


def _merged(n: int, marks: list[tuple[np.ndarray, np.ndarray]]) -> list[list[int]]:
    if not marks:
        return []
    delta = np.zeros(n + 1, np.int64)
    for start, end in marks:
        np.add.at(delta, start, 1)
        np.add.at(delta, end, -1)
    inside = np.cumsum(delta[:-1]) > 0
    return np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]]))).reshape(-1, 2).tolist()


def find_contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard: int = 300_000, block: int = 2_000_000, with_text: bool = False) -> DataFrame:
    """Mark each word of a document that lies inside an occurrence of a test window.

    A-Z is lower-cased; words are runs of ASCII letters and digits and of characters from U+0080 on. A window is `window`
    consecutive words of an item; an item with fewer words, but not none, is one window. Returns for each row doc_id,
    n_words, spans (merged [first word, last word + 1] pairs), n_hit, n_items, items (ids as strings, sorted),
    items_sha256 (of those, comma-joined) and contaminated.

    A null or empty text has no words and is never hit; an item with a null id or without words is left out. Rows are
    judged one by one, so repeated rows get equal results; a null document id is kept. An empty table of documents gives
    an empty result, an empty table of items no hits. Other columns are ignored. `shard` bounds the words that one index
    holds, `block` about how many words of items go to the tasks at once; each further block is one more pass. With
    with_text, the text comes back too, and `kept`: the text without its hit spans (null where there are none).
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).mapInArrow(tidy(_item_words), "item string, words binary")
    blocks = max(1, ceil((items.agg(F.sum(F.octet_length("words"))).first()[0] or 0) / 8 / block))
    schema = "doc_id long, text string, n_words long, spans array<array<int>>, items array<string>, kept string"
    out = docs.withColumns({"n_words": F.lit(None).cast("long"), "spans": F.lit(None).cast("array<array<int>>"), "items": F.lit(None).cast("array<string>"), "kept": F.lit(None).cast("string")})
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(_patterns([(r.item, bytes(r.words)) for r in part.toLocalIterator()], window))
        out = out.mapInArrow(tidy(_hits(shared, window, shard, with_text or k < blocks - 1)), schema)
    return out.select(
        "doc_id",
        *(["text", "kept"] if with_text else []),
        "n_words",
        "spans",
        F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + F.get(x, F.lit(1)) - F.get(x, F.lit(0))).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove_contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, text and kept (the text without its hit spans) of each contaminated document; options and odd cases as in find_contamination."""
    return find_contamination(docs, items, with_text=True, **options).where("contaminated").select("doc_id", "text", "kept")
