"""Phrase collocations of two and three words, counted by direct-address tiles.

Words become frequency-ranked ids, and a pair of ids lies in a tile of the plane of all pairs. A task gathers the pairs of its
texts and counts them tile by tile: a tile with many of them by one dense bincount over its cells, which the pair addresses
directly, the sparse ones as sorted coordinates with counts. Pairs that are frequent in the corpus are ranked anew as if they
were words, and (pair, word) is counted in the same way: these are the phrases of three words. Only counts leave a task, and
Spark adds them up by word keys.

Ranks are a task's means of addressing only: the `words` and `pairs` most frequent ones have them (so what goes to all tasks
has a bound), the others are counted as sorted coordinates of their 64-bit keys, and so nothing is lost. Keys are hashes of
language and word; a vocabulary in which two words share a key is made anew with other hashes, so counts are exact.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import Scratch, small_batches
from ._words import LOWER, _hashes, _table, mix, signed, tidy, words

#: Bytes that end a piece: `[.,;:!?\x0A-\x0D]`; words are `[^\x20\x09]+` of a piece.
_ENDS = _table((0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
_WORD = ~(_ENDS | _table((0x09, 0x09), (0x20, 0x20)))
#: A tile has 2**10 by 2**10 cells; one with this many pairs at hand is counted densely.
_SIDE, _DENSE = 10, 1 << 17
#: Pairs that a task gathers before it counts them, and sparse keys or words that it keeps.
_GATHER, _KEEP = 1 << 22, 1 << 19
_BASES = [None, *(pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64) for k in range(1, 6))]


def _keys(w, lang: np.ndarray, base: int | None) -> np.ndarray:
    """A key for each word of a block, of its text's language and itself; base: of another hash than the usual one."""
    h = w.h if base is None else mix(_hashes(w.buf, w.s, w.e, base) + w.h)
    return mix(h ^ np.repeat(mix(lang[w.lo : w.hi].view(np.uint64)), w.counts()))


def _next(w) -> np.ndarray:
    """Whether the word after each word of a block stands in the same piece."""
    if len(w) < 2:
        return np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(_ENDS[w.buf], dtype=np.int32)])
    row = w.rows()
    return (row[1:] == row[:-1]) & (ends[w.s[1:]] == ends[w.e[:-1]])


def _blocks(batches):
    for batch in batches:
        lang = batch.column("lang_h").to_numpy(zero_copy_only=False)
        for w in words(batch.column("text"), _WORD, lower=True):
            if len(w):
                yield batch, lang, w


def _table_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(signed(x) if x.dtype == np.uint64 else x.astype(np.int64)) for x in columns.values()], list(columns))


def _others(w, first: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Words of a block that are not equal, byte by byte, to the first one of their key."""
    size, like = w.e - w.s, first[same]
    odd = size != size[like]
    size, at = size[~odd], np.flatnonzero(~odd)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    differs = w.buf[np.repeat(w.s[at], size) + step] != w.buf[np.repeat(w.s[like[at]], size) + step]
    odd[at] = np.bincount(np.repeat(np.arange(len(at)), size)[differs], minlength=len(at)) > 0
    return np.flatnonzero(odd)


def _vocabulary(base: int | None):
    """(key, lang, word, n) of a task's words. Each word is compared with that which has its key so far; one that differs has a
    row of its own, by which the clash is seen."""

    @tidy
    def rows(batches):
        place: dict[int, int] = {}
        keys, langs, said, counts = [], [], [], []
        language: dict[int, str] = {}

        def kept():
            out = _table_of(key=np.array(keys, np.uint64), lang=pa.array(langs, pa.string()), word=pa.array(said, pa.binary()).cast(pa.string()), n=np.array(counts, np.int64))
            for x in (place, keys, langs, said, counts):
                x.clear()
            return out

        for batch, lang, w in _blocks(batches):
            for h, name in set(zip(lang[w.lo : w.hi].tolist(), batch.column("lang").slice(w.lo, w.hi - w.lo).to_pylist(), strict=True)):
                if language.setdefault(h, name) != name:  # two languages with one hash
                    for x in (name, language[h]):
                        keys.append(h % (1 << 64)), langs.append(x), said.append(b""), counts.append(0)
            key = _keys(w, lang, base)
            found, first, same, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            names = batch.column("lang").take(pa.array(np.searchsorted(w.off, first, "right") - 1 + w.lo)).to_pylist()
            text = lambda i: w.buf[w.s[i] : w.e[i]].tobytes()  # noqa: B023, E731
            for k, i, name, m in zip(found.tolist(), first.tolist(), names, n.tolist(), strict=True):
                at, word = place.get(k), text(i)
                if at is None or said[at] != word or langs[at] != name:
                    place[k] = len(keys)
                    keys.append(k), langs.append(name), said.append(word), counts.append(m)
                else:
                    counts[at] += m
            for i in _others(w, first, same).tolist():
                keys.append(int(key[i])), langs.append(names[same[i]]), said.append(text(i)), counts.append(0)
            if len(keys) > _KEEP:
                yield kept()
        if keys:
            yield kept()

    return rows


class Ranks:
    """Ranks of keys by frequency, 0 the most frequent, -1 for those without one."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]
        self.mask = np.uint64((1 << max(10, 2 + len(keys).bit_length())) - 1)
        self.near = np.full(int(self.mask) + 1, -1, np.int32)
        self.near[(keys & self.mask).astype(np.int64)[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        rank = self.near[(keys & self.mask).astype(np.int64)].astype(np.int64)
        far = np.flatnonzero((rank >= 0) & (self.keys[rank] != keys))
        at = np.minimum(np.searchsorted(self.sorted, keys[far]), len(self.sorted) - 1)
        rank[far] = np.where(self.sorted[at] == keys[far], self.order[at], -1)
        return rank


class Tiles:
    """Counts of pairs of ranks that a task has gathered."""

    def __init__(self, across: int):
        self.across = max(1, -(-across >> _SIDE))  # tiles in a row of tiles
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether it is time to count."""
        low = (1 << _SIDE) - 1
        self.codes.append(((a >> _SIDE) * self.across + (b >> _SIDE)) << 2 * _SIDE | (a & low) << _SIDE | b & low)
        self.size += len(a)
        return self.size >= _GATHER

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs and how often each was added since the last time."""
        codes = np.concatenate(self.codes) if self.codes else np.empty(0, np.int64)
        self.codes, self.size = [], 0
        tile, cells = codes >> 2 * _SIDE, 1 << 2 * _SIDE
        here, spot, many = np.unique(tile, return_inverse=True, return_counts=True)
        dense = many >= _DENSE
        code, n = np.unique(codes[~dense[spot]], return_counts=True)  # sorted coordinates
        out = [(code, n)]
        for k in np.flatnonzero(dense).tolist():
            count = np.bincount(codes[spot == k] & (cells - 1), minlength=cells)
            cell = np.flatnonzero(count)
            out.append((here[k] * cells + cell, count[cell]))
        code, n = (np.concatenate(x) for x in zip(*out, strict=True))
        low, tile = (1 << _SIDE) - 1, code >> 2 * _SIDE
        return tile // self.across << _SIDE | code >> _SIDE & low, tile % self.across << _SIDE | code & low, n


class Sparse:
    """Counts of tuples of keys of which some has no rank, as sorted coordinates."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *keys: np.ndarray) -> bool:
        self.parts.append(keys)
        self.size += len(keys[0])
        return self.size >= _KEEP

    def counts(self) -> tuple[list[np.ndarray], np.ndarray]:
        columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        start = np.flatnonzero(new)
        return [c[start] for c in columns], np.diff(np.append(start, len(order)))


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + b)


def _pairs(shared, base: int | None):
    """(a, b, n): keys of neighbours in a piece and how often a task has seen them. Words without rank are left out if all
    frequent ones have a rank."""

    @tidy
    def rows(batches):
        known, whole = shared.value
        ranks = Ranks(known)
        tiles, sparse = Tiles(len(known)), Sparse()
        counted = lambda: (lambda a, b, n: _table_of(a=known[a], b=known[b], n=n))(*tiles.counts())
        rest = lambda: (lambda k, n: _table_of(a=k[0], b=k[1], n=n))(*sparse.counts())
        for _, lang, w in _blocks(batches):
            key, i = _keys(w, lang, base), np.flatnonzero(_next(w))
            rank = ranks.of(key)
            both = (rank[i] >= 0) & (rank[i + 1] >= 0)
            if tiles.add(rank[i[both]], rank[i[both] + 1]):
                yield counted()
            if not whole and sparse.add(key[i[~both]], key[i[~both] + 1]):
                yield rest()
        if tiles.size:
            yield counted()
        if sparse.size:
            yield rest()

    return rows


def _triples(shared, base: int | None):
    """(a, b, c, n): keys of three words in a row in a piece. A frequent pair's rank and the third word's address a tile."""

    @tidy
    def rows(batches):
        known, whole_words, first, second, whole_pairs = shared.value
        ranks, pair_ranks = Ranks(known), Ranks(_pair_key(first, second))
        tiles, sparse, whole = Tiles(len(known)), Sparse(), whole_words and whole_pairs
        counted = lambda: (lambda p, c, n: _table_of(a=first[p], b=second[p], c=known[c], n=n))(*tiles.counts())
        rest = lambda: (lambda k, n: _table_of(a=k[0], b=k[1], c=k[2], n=n))(*sparse.counts())
        for _, lang, w in _blocks(batches):
            key, near = _keys(w, lang, base), _next(w)
            pair = np.full(len(near), -1, np.int64)
            at = np.flatnonzero(near)
            p = pair_ranks.of(_pair_key(key[at], key[at + 1]))
            same = (p >= 0) & (first[p] == key[at]) & (second[p] == key[at + 1]) if len(first) else p >= 0
            pair[at] = np.where(same, p, -1)
            i = np.flatnonzero(near[:-1] & near[1:]) if len(near) > 1 else np.empty(0, np.int64)
            if whole_pairs:
                i = i[(pair[i] >= 0) & (pair[i + 1] >= 0)]
            c = ranks.of(key[i + 2])
            both = (pair[i] >= 0) & (c >= 0)
            if tiles.add(pair[i[both]], c[both]):
                yield counted()
            j = i[~both]
            if not whole and len(j) and sparse.add(key[j], key[j + 1], key[j + 2]):
                yield rest()
        if tiles.size:
            yield counted()
        if sparse.size:
            yield rest()

    return rows


def _head(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The rows of the largest n, as many as have room among `most`, and whether these are all. n is compared by its five
    leading bits, of which there are few values."""
    shift = F.greatest(F.length(F.bin("n")) - 5, F.lit(0))
    low = F.expr("shiftleft(shiftright(n, s), s)")
    sizes = df.withColumn("s", shift.cast("int")).groupBy(low.alias("low")).count().collect()
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["low"]):
        if total + r["count"] > most:
            return (df.where(F.col("n") >= least) if least is not None else df.where("false")), False
        total, least = total + r["count"], r["low"]
    return df, True


def _collected(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a few rows as unsigned numbers, in order of falling n."""
    rows = df.select("n", *names).toArrow()
    rows = rows.sort_by([("n", "descending"), *[(c, "ascending") for c in names]])
    return [rows[c].to_numpy().view(np.uint64) for c in names]


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly: decimals of 38 digits, whole-number division."""
    exact = [x.cast("decimal(15,0)") for x in (a, left, right)]
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * exact[0] * exact[0], exact[1] * exact[2]).cast("long")


@functools.cache
def _schema(*names: str) -> str:
    return ", ".join(f"{n} {'string' if n in ('lang', 'word') else 'long'}" for n in names)


def count_phrases(docs: DataFrame, scratch: Scratch, least: int = 10, words: int = 1 << 18, pairs: int = 1 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables (key, lang, word, n) of all words, (a, b, n) and (a, b, c, n) of the phrases of two and three words that occur at least
    `least` times, by keys of words. Null texts have no words, a null language is `und`."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    lang = F.coalesce("lang", F.lit("und"))
    for k, base in enumerate(_BASES):
        texts = docs.where("text is not null").select(lang.alias("lang"), F.xxhash64(lang, F.lit(k)).alias("lang_h"), "text")
        seen = texts.mapInArrow(_vocabulary(base), _schema("key", "lang", "word", "n")).groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))
        vocabulary = scratch.save(seen, f"words{k}")
        if vocabulary.groupBy("key").count().where("count > 1").isEmpty():
            break
        scratch.drop(f"words{k}")
    else:
        raise ValueError("two words of one language have equal hashes by every base")
    head, whole = _head(vocabulary.where(F.col("n") >= least), words)
    (known,) = _collected(head, "key")
    shared = spark.sparkContext.broadcast((known, whole))
    found = texts.select("lang_h", "text").mapInArrow(_pairs(shared, base), _schema("a", "b", "n")).groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    twos = scratch.save(found, "pairs")
    head, whole_pairs = _head(twos, pairs)
    first, second = _collected(head, "a", "b")
    if len(np.unique(_pair_key(first, second))) < len(first):  # then those keys can't rank pairs: all go without
        first, second, whole_pairs = first[:0], second[:0], False
    shared = spark.sparkContext.broadcast((known, whole, first, second, whole_pairs))
    found = texts.select("lang_h", "text").mapInArrow(_triples(shared, base), _schema("a", "b", "c", "n")).groupBy("a", "b", "c").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return vocabulary, twos, scratch.save(found, "triples")


def mine_phrases(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, words: int = 1 << 18, pairs: int = 1 << 20) -> DataFrame:
    """The `top` collocations of each language of docs (lang, text; others are ignored): lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of two and three words with a >= least occurrences in pieces of texts (overlaps count; A-Z in lower
    case). Cut in two, with l and r occurrences of the parts, a candidate scores floor(1000000 a a / (l r)); its lowest-scoring
    cut counts, of equal ones the first. Two words that lie in a candidate of three with at least `share` percent of their
    occurrences are left out. Ties go by a, then by the phrase's bytes; n counts all words of the language.

    Null texts are empty, a null language is `und`; repeated rows count each; an empty table gives an empty one. What goes to
    all tasks are at most `words` keys of words and `pairs` of pairs (8 and 16 bytes each); rarer ones are counted without
    ranks. No limit but that on the rows returned, which is the feature."""
    scratch = Scratch(docs.sparkSession, "phrases")
    vocabulary, twos, threes = count_phrases(docs, scratch, least, words, pairs)
    often = vocabulary.where(F.col("n") >= least)
    named = lambda *names: often.select(*[F.col(c).alias(x) for c, x in zip(("key", "lang", "word", "n"), names, strict=True) if x]).hint("merge")
    two = twos.join(named("a", "lang", "wa", "fa"), "a").join(named("b", None, "wb", "fb"), "b")
    two = scratch.save(two.select("a", "b", "n", "lang", "wa", "wb", "fa", "fb"), "named")
    front = two.select("a", "b", "lang", "wa", "wb", "fa", F.col("n").alias("fab"))
    back = two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("wb").alias("wc"), F.col("fb").alias("fc"), F.col("n").alias("fbc"))
    three = threes.join(front.hint("merge"), ["a", "b"]).join(back.hint("merge"), ["b", "c"])
    n = F.col("n")
    early, late = _score(n, F.col("fa"), F.col("fbc")), _score(n, F.col("fab"), F.col("fc"))
    three = three.withColumn("early", early).withColumn("late", late).withColumn("second", F.col("late") < F.col("early"))
    cut = lambda x, y: F.when(F.col("second"), F.col(x)).otherwise(F.col(y))
    phrases = three.select("lang", F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), n.alias("a"), cut("fab", "fa").alias("l"), cut("fc", "fbc").alias("r"), F.least("early", "late").alias("score"))
    inside = threes.select("a", "b", "n").unionByName(threes.select(F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("a", "b").agg(F.max("n").alias("longer"))
    alone = two.join(inside.hint("merge"), ["a", "b"], "left").where(F.coalesce(100 * F.col("longer") < share * n, F.lit(True)))
    phrases = phrases.unionByName(alone.select("lang", F.concat_ws(" ", "wa", "wb").alias("phrase"), n.alias("a"), F.col("fa").alias("l"), F.col("fb").alias("r"), _score(n, F.col("fa"), F.col("fb")).alias("score")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = Window.partitionBy("lang", "salt").orderBy(*order)
    best = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = best.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("total"))
    out = ranked.join(totals.hint("merge"), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
