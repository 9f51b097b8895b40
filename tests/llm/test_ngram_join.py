import random
import re

import pytest
from _texts import SCHEMA, corpus

from quillsieve.llm import ngram_join
from quillsieve.llm._scratch import Scratch
from quillsieve.llm.ngram_join import jaccard_classes


def brute(rows, n=5, percent=75):
    sets = []
    for d, t, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    root, links = {d: d for d, _ in sets}, dict.fromkeys((d for d, _ in sets), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(s), find(d), links[d]) for d, s in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize("seed,n", [(1, 5), (2, 2)])
def test_equals_brute_force(spark, seed, n):
    rows = corpus(seed=seed, n=90)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(jaccard_classes(docs, n=n)) == brute(rows, n)


def test_exact_way(spark):
    """Whole sets as sketches, all of whose tokens count: no chance is left."""
    rows = corpus(seed=6, n=60)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(jaccard_classes(docs, sketch=10_000, shared=10_000)) == brute(rows)


def test_bitmaps_prune(spark):
    """Of twenty unlike leaves of one family and one size only those meet whose sketches have enough in common, or themselves."""
    rng = random.Random(8)
    sketches = [[rng.randrange(1 << 62) for _ in range(48)] for _ in range(20)]
    sketches[7][:20], sketches[19][:16], sketches[12][:15] = sketches[3][:20], sketches[0][:16], sketches[1][:15]
    leaves = spark.createDataFrame([(5, k, 100, x) for k, x in enumerate(sketches)] + [(5, 20, 1000, sketches[3])], "family long, leaf long, n long, sketch array<long>")
    pairs = ngram_join._leaf_pairs(ngram_join._nodes(leaves), 21, 75, 16, Scratch(spark, "pairs"))
    assert {(r.x, r.y) for r in pairs.collect()} == {(k, k) for k in range(21)} | {(3, 7), (0, 19)}


def test_trees_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_LEAF", 3)
    monkeypatch.setattr(ngram_join, "_FAN", 1)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        rows.append((k, " ".join(w[rng.randint(0, 25) :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_classes(docs)) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, "A b c"), (5, "a B c"), (3, "a b C"), (None, "a b c"), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({"x": "x"})
    out = sorted(map(tuple, jaccard_classes(docs).collect()), key=str)
    assert out == sorted([(5, 1, 3, 2), (5, 1, 3, 2), (3, 1, 3, 2), (None, 1, None, 0), (9, 0, 9, 0), (8, 0, 8, 0)], key=str)
    assert jaccard_classes(docs.limit(0)).count() == 0


def test_one_id_for_several_texts(spark):
    """Documents 2 and 3 are near to two texts of document 1, 5 and 4 to two of document 7, and 6 to one of 9."""
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(6)]
    a, b, c, d, e, f = texts
    near = lambda t: t + " more"
    rows = [(1, a), (1, b), (2, near(b)), (3, near(a)), (7, c), (7, d), (5, near(c)), (4, near(d)), (9, e), (9, f), (6, near(e)), (1, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(1, 1, 2), (1, 1, 1), (2, 1, 1), (3, 1, 2), (7, 4, 1), (7, 4, 1), (5, 4, 1), (4, 4, 1), (9, 6, 1), (9, 6, 0), (6, 6, 1), (1, 1, 2)]
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in jaccard_classes(docs).collect()) == sorted(want)
