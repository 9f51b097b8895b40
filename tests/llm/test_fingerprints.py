import hashlib

from _texts import SCHEMA, corpus

from quillsieve.llm.fingerprints import compare_edited


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for k, (d, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        yield d, (len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()), order[(k + 1) % len(order)][0]


def test_next_and_edited_texts(spark):
    rows = corpus(seed=8)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for size in (24 << 20, 900):
        got = {r.doc_id: r for r in compare_edited(docs, range_bytes=size).collect()}
        assert len(got) == len(rows)
        by_text = {}
        for d, (n, sha), after in expected(rows):
            r = got[d]
            assert (r.n_chars, r.edited_sha256) == (n, sha)
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            assert (r.near_next == 1.0) == (r.fingerprint == got[after].fingerprint)
            by_text.setdefault(dict((x[0], x[1]) for x in rows)[d] or "", set()).add(r.fingerprint)
        assert all(len(x) == 1 for x in by_text.values())


def test_fingerprint_by_hand(spark):
    """Terms outside the band don't matter; those inside do."""
    rows = [(k, f"common word{k} shared{k % 5} Other{k % 4}") for k in range(40)]
    docs = spark.createDataFrame([*rows, (40, "common shared1 other1 unique"), (41, "OTHER1, shared1! shared1 common nothing")], "doc_id long, text string")
    from pyspark.sql import functions as F

    from quillsieve.llm.fingerprints import fingerprint, lexicon

    lists = lexicon(docs, least=0.1, most=0.5)
    assert {t for x in docs.limit(1).select(lists.alias("l")).first().l for t in x} == {*(f"shared{k}" for k in range(5)), *(f"other{k}" for k in range(4))}
    got = {r.doc_id: r.f for r in docs.select("doc_id", fingerprint(F.col("text"), lists).alias("f")).collect()}
    assert got[40] == got[41] == got[21] and got[40] != got[2]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x y"), (4, None), (4, None), (9, "")], "doc_id long, text string").withColumnsRenamed({})
    out = compare_edited(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in out) == [("4", 0), ("4", 0), ("9", 0), ("None", 3)]
    assert compare_edited(docs.limit(0)).count() == 0
    one = compare_edited(docs.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_texts_outside_the_band(spark):
    """Different texts without a term of the lexicon are not alike, equal terms are."""
    rows = [(k, "in band" if k % 5 else "other") for k in range(40)] + [(k, t) for k, t in zip(range(40, 47), ["This.", "The esingor.", "this", "?!", "...", "", None])]
    from pyspark.sql import functions as F

    from quillsieve.llm.fingerprints import fingerprint, lexicon, likeness

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lists = lexicon(docs, least=0.1, most=0.5)
    f = {r.doc_id: r.f for r in docs.select("doc_id", fingerprint(F.coalesce("text", F.lit("")), lists).alias("f")).collect()}
    assert f[40] == f[42] and f[45] == f[46] and len({f[k] for k in (0, 40, 41, 43, 44, 45)}) == 6
    pair = spark.createDataFrame([(f[40], f[41]), (f[40], f[42]), (f[40], f[0])], "a string, b string").select(likeness(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in pair.collect()] == [0.0, 1.0, 0.0]


def test_recall_of_near_copies(spark):
    """Texts with a share of their words replaced, and unlike texts, by the rule of alike()."""
    import random

    from pyspark.sql import functions as F

    from quillsieve.llm.fingerprints import alike, fingerprint, lexicon

    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lists = lexicon(docs)
    texts = [r.text.split() for r in docs.where("doc_id % 3 = 0").select("text").collect() if r.text and len(r.text.split()) >= 20]
    pairs = []
    for w in texts:
        for percent in (1, 2, 5):
            v = list(w)
            for _ in range(max(1, round(percent * len(w) / 100))):
                v[rng.randrange(len(v))] = rng.choice(rng.choice(texts))
            pairs.append((percent, " ".join(w), " ".join(v)))
        other = rng.choice(texts)
        if other != w:
            pairs.append((100, " ".join(w), " ".join(other)))
    df = spark.createDataFrame(pairs, "percent int, a string, b string").repartition(4)
    df = df.select("percent", alike(fingerprint(F.col("a"), lists), fingerprint(F.col("b"), lists)).cast("int").alias("hit"))
    share = {r.percent: r.share for r in df.groupBy("percent").agg(F.avg("hit").alias("share")).collect()}
    assert share[1] > 0.97 and share[2] > 0.95 and share[5] > 0.9 and share[100] < 0.01


def test_lexicon_is_bounded(spark):
    docs = spark.createDataFrame([(k, " ".join(f"t{j}" for j in range(40) if k % (2 + j % 7) == 0)) for k in range(90)], "doc_id long, text string")
    from quillsieve.llm.fingerprints import lexicon

    size = lambda n: sum(map(len, docs.limit(1).select(lexicon(docs, most=1.0, largest=n).alias("l")).first().l))
    assert size(100) == 40 and size(20) == 18 and size(3) == 0


def test_many_ranges_long_texts_and_clashing_columns(spark):
    rows = [(k * 7 % 101, "wort " * (k % 9)) for k in range(101)] + [(500, "ein langer text " * 40_000), (501, None)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, after int").withColumns({c: F_lit(c) for c in ("range", "h", "head", "next", "df", "term")})
    for size in (1, 100, 1 << 30):
        got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in compare_edited(docs, range_bytes=size).collect()}
        assert got == {d: x for d, x, _ in expected(rows)}


def F_lit(c):
    from pyspark.sql import functions as F

    return F.lit(c)
