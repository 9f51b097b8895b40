import hashlib
import random
import re

import numpy as np
import pytest
from _texts import SCHEMA, corpus

from quillsieve.llm._fm_index import FMIndex, suffix_array
from quillsieve.llm.decontaminate import find_contamination


def split(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, window=10):
    wins = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1)):
            if w and i is not None:
                wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = {}
    for d, t, *_ in rows:
        w, hit, own = split(t), set(), set()
        for win, who in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    own |= who
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    return out


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    for _ in range(20):
        pieces = [rng.integers(5, 5 + rng.integers(1, 5), rng.integers(0, 60)).astype(np.uint64) for _ in range(8)] + [np.array([5], np.uint64)] * 3
        lens = np.array([len(p) for p in pieces])
        text = np.concatenate([np.append(p, 0) for p in pieces]).astype(np.int64)
        ends = np.cumsum(lens + 1) - 1
        key = lambda i: [(x, j if x == 0 else 0) for j, x in enumerate(text[i:], i)]  # noqa: E731, B023
        assert suffix_array(text, ends).tolist() == sorted(range(len(text)), key=key)
        index = FMIndex(pieces, sample=4)
        pats = [tuple(rng.integers(5, 9, rng.integers(1, 5))) for _ in range(40)]
        m = np.zeros((40, 4), np.uint64)
        for k, p in enumerate(pats):
            m[k, : len(p)] = p
        lo, hi = index.search(m, np.array([len(p) for p in pats]))
        for k, p in enumerate(pats):
            where = sorted((t, i) for t, x in enumerate(pieces) for i in range(len(x) - len(p) + 1) if tuple(x[i : i + len(p)]) == p)
            got = index.locate(np.arange(lo[k], hi[k]))
            assert sorted(zip(*(x.tolist() for x in got), strict=True)) == where


@pytest.mark.parametrize("shard,block", [(300_000, 2_000_000), (37, 60)])
def test_equals_brute_force(spark, shard, block):
    rows = corpus(seed=4)
    rng = random.Random(2)
    texts = [t for _, t, *_ in rows if t and len(split(t)) > 40]
    items = [(k, " ".join(split(rng.choice(texts))[a : a + rng.randint(3, 25)]).upper()) for k in range(12) for a in [rng.randint(0, 20)]]
    items += [(90, None), (91, "..."), (92, "zz yy"), (93, "one"), (94, rows[3][1]), (94, "two words")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = find_contamination(docs, bench, shard=shard, block=block)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()} == brute(rows, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (2, None, 2)], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(None, "a b")], "item_id long, text string")
    assert [r.n_hit for r in find_contamination(docs, bench).collect()] == [0, 0]
    assert find_contamination(docs.limit(0), bench).count() == 0
