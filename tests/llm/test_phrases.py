import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillsieve.llm import phrases
from quillsieve.llm._scratch import Scratch
from quillsieve.llm.phrases import Sparse, Tiles, count_phrases, mine_phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(docs, least, share=50, top=2000):
    """The definition, one text after the other."""
    f, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, count in f.items():
        known, rows = {p: a for p, a in count.items() if len(p) > 1 and a >= least}, []
        for p, a in known.items():
            if any(len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in known.items()):
                continue
            score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, k + 1, r[2].decode(), -r[1], r[3], r[4], total[lang], -r[0]) for k, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


def made(n=120, seed=4):
    rng = random.Random(seed)
    pool = ["The", "new", "york", "times", "é", "é", "日本", "a-b", "\x00", "x\x1cy", "san", "francisco", "of", "THE"]
    texts = []
    for _ in range(n):
        parts = [rng.choice(["new york times", "San Francisco", "of the of the of", rng.choice(pool), rng.choice(pool)]) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ",", "!", "\r\n", "a:b"]) for _ in range(rng.randint(0, 30))]
        texts.append(("".join(parts), rng.choice(["en", "en", "de", None, "und", ""])))
    return [*texts, (None, "en"), ("", "de"), (" \t\n.", None), ("one", "xx"), ("same same " * 3000, "long"), ("unbroken" * 5000 + " tail", "long")]


@pytest.mark.parametrize("words, pairs, least, gather", [(1 << 18, 1 << 20, 3, 1 << 22), (4, 3, 2, 40), (0, 0, 2, 40), (1 << 18, 2, 3, 40), (3, 1 << 20, 10, 40)])
def test_phrases_equal_the_definition(spark, monkeypatch, words, pairs, least, gather):
    monkeypatch.setattr(phrases, "_GATHER", gather)
    monkeypatch.setattr(phrases, "_KEEP", gather)
    docs = made()
    df = spark.createDataFrame([(k // 2, t, g, 1, "x") for k, (t, g) in enumerate(docs)], "doc_id long, text string, lang string, n long, word string").repartition(3)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in mine_phrases(df, least=least, words=words, pairs=pairs).collect())
    assert got == plain(docs, least)
    if least == 3:
        assert sorted(tuple(r[c] for c in COLUMNS) for r in mine_phrases(df, least=least, top=2).collect()) == plain(docs, least, top=2)


def test_words_with_equal_hashes_are_hashed_anew(spark, monkeypatch):
    real = phrases._keys
    monkeypatch.setattr(phrases, "_keys", lambda w, lang, base: real(w, lang, base) if base else real(w, lang, base) & np.uint64(3))
    docs = [("a b c d e f g h " * 3, "en")]
    df = spark.createDataFrame(docs, "text string, lang string")
    scratch = Scratch(spark, "test")
    vocabulary, twos, _ = count_phrases(df, scratch, 2)
    assert vocabulary.count() == 8 and twos.count() == 8 and "words1" in scratch.names


def test_empty_tables(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert mine_phrases(df).count() == 0
    assert mine_phrases(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_scores_are_exact(spark):
    rows = [(10**14, 10**14 + 1, 10**14 + 3), (10**14, 10**14, 10**14), (999_999_999_999, 10**12, 10**12), (10, 10**15 - 1, 10**15 - 1), (3, 7, 3)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    assert [r[0] for r in df.select(phrases._score(df.a, df.l, df.r)).collect()] == [1_000_000 * a * a // (x * y) for a, x, y in rows]


def test_tiles_count_dense_and_sparse():
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.integers(0, 40, 200_000), rng.integers(0, 9000, 5000), rng.integers(5000, 5020, 150_000)])
    b = np.concatenate([rng.integers(0, 30, 200_000), rng.integers(0, 3000, 5000), rng.integers(2990, 3000, 150_000)])
    tiles = Tiles(3000)
    tiles.add(a[:1000], b[:1000]), tiles.add(a[1000:], b[1000:])
    got = {(x, y): n for x, y, n in zip(*[c.tolist() for c in tiles.counts()], strict=True)}
    assert got == Counter(zip(a.tolist(), b.tolist(), strict=True)) and len(tiles.counts()[0]) == 0
    sparse = Sparse()
    sparse.add(a.astype(np.uint64), b.astype(np.uint64))
    keys, n = sparse.counts()
    assert {(x, y): k for x, y, k in zip(keys[0].tolist(), keys[1].tolist(), n.tolist(), strict=True)} == got
