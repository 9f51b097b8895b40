"""The inverted index against all pairs, and verdicts against their SQL."""

import random

import pytest

from quillsieve.operators import retrieval, vectors

PAPERS = "paper_id long, title string, authors string, journal string, year int, doi string, document string"


def made(seed, papers=60, queries=80):
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randint(0, 60), rng.randint(0, 60), rng.randint(0, 60))}"  # noqa: E731  few are frequent
    known = [(k * 7 % 101, f"{word()} {word()} title", rng.choice([None, "A B", "Author"]), None, rng.choice([None, 1999, 2001]), None, " ".join(word() for _ in range(rng.randint(0, 25)))) for k in range(papers)]
    known += [(200, None, None, None, None, None, None), (201, "same", None, None, None, None, "w1 w2 w3"), (202, "same", None, None, None, None, "w3 w2 w1"), (None, "no id", None, None, 1, None, "w0")]
    asked = [(k, rng.choice([" ".join(word() for _ in range(rng.randint(0, 12))), rng.choice(known[:papers])[6], "w1 w2 w3 same", "w0", None, "", "unknown words only", "w0 w1, w2 title 1999; w3"]), rng.choice(["", "1999", None])) for k in range(queries)]
    return known, asked


@pytest.mark.parametrize("seed, bits, steps, top, k", [(1, 62, (32, 16, 10), 10, 3), (2, 12, (8, 5, 2), 2, 3), (3, 6, (3, 1), 1, 1), (4, 20, (10, 3), 3, 5), (5, 3, (2,), 2, 2)])
def test_index_equals_all_pairs(spark, monkeypatch, seed, bits, steps, top, k):
    monkeypatch.setattr(retrieval, "_BITS", bits)
    monkeypatch.setattr(retrieval, "_STEPS", steps)
    monkeypatch.setattr(retrieval, "_TOP", top)
    known, asked = made(seed)
    papers, queries = spark.createDataFrame(known, PAPERS), spark.createDataFrame(asked, "id long, text string, years string")
    pairs = retrieval.SqlOperator("queries papers", retrieval.paper_topk_all_pairs.sql.replace("k <= 3", f"k <= {k}"))(queries, papers.where("paper_id is not null"))
    want = sorted(map(tuple, pairs.collect()))
    assert sorted(map(tuple, retrieval.paper_topk(queries, papers, k=k).collect())) == want and want


def test_empty_tables(spark):
    known, asked = made(1, 5, 5)
    papers, queries = spark.createDataFrame(known, PAPERS), spark.createDataFrame(asked, "id long, text string, years string")
    assert retrieval.paper_topk(queries.limit(0), papers).count() == retrieval.paper_topk(queries, papers.limit(0)).count() == 0
    none = retrieval.verify(queries, retrieval.paper_topk(queries, papers.limit(0)), papers.limit(0)).collect()
    assert len(none) == len(asked) and all(r.no_candidate and r.verdict == "unverified" for r in none)


def test_verdicts_equal_their_sql(spark):
    known, asked = made(6)
    papers, queries = spark.createDataFrame(known[:-1], PAPERS), spark.createDataFrame(asked, "id long, text string, years string")
    best = spark.createDataFrame(retrieval.paper_topk(queries, papers).collect(), "id long, paper_id long, year int, score double, cover double, k int")
    want = sorted((tuple(r) for r in retrieval.verified(queries.fillna("", ["years"]), best, papers).collect()), key=str)
    assert sorted((tuple(r) for r in retrieval.verify(queries, best, papers).collect()), key=str) == want


def plain_topk(vectors, queries, k, itself):
    import numpy as np

    out = []
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
    for q, a in queries:
        scored = sorted((-(round(float(unit(a) @ unit(b)), 6) + 0.0), v) for v, b in vectors if itself or v != q)
        out += [(q, v, n + 1, -s) for n, (s, v) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed, pivots, k, itself", [(1, 64, 3, False), (2, 5, 2, True), (3, 1, 4, False), (4, 12, 3, True)])
def test_nearest_vectors_equal_all_pairs(spark, monkeypatch, seed, pivots, k, itself):
    monkeypatch.setattr(vectors, "_VECTORS", 7)
    monkeypatch.setattr(vectors, "_QUERIES", 3)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    near = lambda: [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]
    rows = [(d, near()) for d in range(150)]
    rows += [(200 + d, rows[d % 4][1]) for d in range(12)] + [(300, [0.0] * 6), (301, [0.0] * 6), (302, [-x for x in rows[0][1]])]
    some = [*rows[::11], rows[-1], rows[-2], (900, [0.0] * 5 + [1.0])]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (999, None)], schema).repartition(3)
    asked = spark.createDataFrame([*some, (None, rows[0][1]), (998, None)], schema)
    got = sorted((r.query_id, r.vec_id, r.k, r.score) for r in vectors.vector_topk(df, asked, k, pivots, itself).collect())
    assert got == plain_topk(rows, some, k, itself)


def test_bounds_leave_clusters_out(spark, monkeypatch):
    """Of ten tight clusters a query sees its own only."""
    seen = []
    real = vectors.Tables.write
    monkeypatch.setattr(vectors.Tables, "write", lambda self, df, name, batch=None: seen.append((name, real(self, df, name, batch))) or seen[-1][1])
    rows = [(d, [1.0 if k == d % 10 else 0.001 * (d // 10) for k in range(10)]) for d in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id < 10")
    assert vectors.vector_topk(df, asked, pivots=100).count() == 30
    assert dict(seen)["far-queries"].where("cluster is not null").count() < 30


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert vectors.vector_topk(df.limit(0), df).count() == vectors.vector_topk(df, df.limit(0)).count() == 0
    assert sorted(map(tuple, vectors.vector_topk(df.where("vec_id = 2"), df).collect())) == [(1, 2, 1, 0.0)]


def shuffled_rows(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_no_row_for_each_pair_that_shares_a_token(spark):
    """Every query shares rare and frequent tokens with every paper: rows grow with both tables, not with their product."""
    words = [f"w{k}" for k in range(40)]
    papers = spark.createDataFrame([(p, f"p{p}", None, None, 2000, None, " ".join(words[p % 7 :])) for p in range(120)], PAPERS)
    queries = spark.createDataFrame([(q, " ".join(words[: 30 + q % 9]) + f" q{q}") for q in range(300)], "id long, text string")
    before = shuffled_rows(spark)
    got = retrieval.paper_topk(queries, papers).collect()
    rows = sum(n for key, n in shuffled_rows(spark).items() if key not in before)
    assert len(got) == 900 and rows < 5_000
    pairs = retrieval.paper_topk_all_pairs(queries, papers)
    assert sorted(map(tuple, got)) == sorted(map(tuple, pairs.collect()))


def test_ranks_are_those_of_rounded_scores(spark):
    """1/1024 has ten digits and is rounded up; several rows of one id are ranked together, as in the SQL."""
    papers = spark.createDataFrame([(p, "a", None, None, None, None, " ".join(f"p{p}x{k}" for k in range(511 + p % 2))) for p in range(6)], PAPERS)
    queries = spark.createDataFrame([(q // 2, "a " + " ".join(f"q{k}" for k in range(512 - q % 3))) for q in range(8)], "id long, text string")
    want = sorted(map(tuple, retrieval.paper_topk_all_pairs(queries, papers).collect()), key=str)
    strip = lambda rows: sorted((r[0], r[3], r[5]) for r in rows)  # noqa: E731  rows of an id that tie have the same papers
    assert strip(map(tuple, retrieval.paper_topk(queries, papers).collect())) == strip(want) and len(want) == 12


def test_verdicts_shuffle_no_row_for_each_pair(spark):
    words = [f"w{k}" for k in range(40)]
    papers = spark.createDataFrame([(p, f"w1 w2 w{p}", "A B", None, 2000, None, " ".join(words[p % 7 :])) for p in range(120)], PAPERS)
    queries = spark.createDataFrame([(q, " ".join(words[: 30 + q % 9]) + f", w1 w2 w{q} x; y z A B. w1 w2 w{q}") for q in range(300)], "id long, text string")
    before = shuffled_rows(spark)
    got = retrieval.verify(queries, retrieval.paper_topk(queries, papers), papers).collect()
    assert sum(n for key, n in shuffled_rows(spark).items() if key not in before) < 5_000
    best = retrieval.paper_topk_all_pairs(queries, papers)
    want = retrieval.verified(queries.withColumn("years", retrieval.F.lit("")), best, papers).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 300
