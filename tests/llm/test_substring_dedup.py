import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from _texts import SCHEMA, corpus

from quillsieve.llm import substring_dedup
from quillsieve.llm.substring_dedup import remove_repeats


def brute(rows, window=20):
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t, *_ in rows}
    seen, out = set(), {}
    for d in sorted(split):
        w, gone = split[d], set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed,window,prefix,group", [(1, 20, 8, 1 << 13), (2, 20, 8, 2), (3, 6, 3, 5), (4, 10, 8, 1), (5, 16, 4, 3), (6, 20, 8, 20)])
def test_equals_brute_force(spark, seed, window, prefix, group):
    """Also with groups so small that prefixes are lengthened once or up to a whole window."""
    rows = corpus(seed=seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, window=window, prefix=prefix, group=group).collect()}
    assert got == brute(rows, window)


def test_subtrees_by_hand(monkeypatch):
    """Segments of two prefixes in several batches: nodes of four words, in groups that are taken one by one."""
    monkeypatch.setattr(substring_dedup, "_GROUP", 20)
    rng = np.random.default_rng(5)
    segments = [(int(k // 40), int(d), int(a), w) for k in range(80) for d, a, w in [(rng.integers(0, 9), rng.integers(0, 5) * 10, rng.integers(0, 3, rng.integers(4, 8)))]]
    segments = [(k, d, a, [10 * k + x for x in w]) for k, d, a, w in sorted(segments, key=lambda x: x[0])]  # words tell the prefix
    want, seen = set(), {}
    every = [(tuple(w[i : i + 4]), d, a + i) for _, d, a, w in segments for i in range(len(w) - 3)]
    for w, d, a in every:
        seen[w] = min(seen.get(w, (d, a)), (d, a))
    want = {(d, a) for w, d, a in every if seen[w] != (d, a)}
    rows = pa.table({"key": [s[0] for s in segments], "doc_id": [s[1] for s in segments], "at": pa.array([s[2] for s in segments], pa.int32()), "many": pa.array([len(s[3]) - 3 for s in segments], pa.int32()), "words": [b"".join(int(x).to_bytes(substring_dedup._WORD, "little") for x in s[3]) for s in segments]})
    got = {(d, a + i) for b in substring_dedup._subtrees(4)(rows.to_batches(max_chunksize=7)) for d, a, m in zip(*(c.to_pylist() for c in b.columns), strict=True) for i in range(m)}
    assert got == want


def test_common_prefixes():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2, 300).astype(np.uint64)
    for window in (4, 6, 20, 31):
        a, b = rng.integers(0, 300 - window, (2, 500))
        want = [next((k for k in range(window) if h[i + k] != h[j + k]), window) for i, j in zip(a, b, strict=True)]
        assert substring_dedup._common_prefix(substring_dedup._ranks(h, window), a, b, window).tolist() == want


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text), (5, text), (7, text), (None, text), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "x")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(docs).collect()), key=str)
    assert got == sorted([(5, 30, 0), (5, 30, 0), (7, 30, 30), (None, 30, 0), (9, 0, 0)], key=str)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_kept_text_and_spans(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, 0), (2, "head " + text + "\ntail", 0)], "doc_id long, text string, at int")
    got = {r.doc_id: r for r in remove_repeats(docs, with_text=True).collect()}
    assert got[1].kept is None and got[1].spans is None
    assert got[2].kept == "head tail" and got[2].spans == [[1, 31]]


def test_one_id_for_several_texts(spark):
    """Document 5 holds a copy of document 3, a text with the same passage, and one of its own twice."""
    passage = " ".join(f"w{k}" for k in range(25))
    texts = {"copy": passage, "more": "some " + passage + " words", "own": " ".join(f"v{k}" for k in range(30))}
    rows = [(3, passage), (5, texts["copy"]), (5, texts["more"]), (5, texts["own"]), (5, texts["own"]), (8, texts["own"] + " end"), (None, passage), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(docs).collect()), key=str)
    assert got == sorted([(3, 25, 0), (5, 25, 25), (5, 27, 25), (5, 30, 0), (5, 30, 0), (8, 31, 30), (None, 25, 0), (9, 0, 0)], key=str)
