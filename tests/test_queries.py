"""Each audit query against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from quillsieve.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else repr(round(v, 9))) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(ORACLE[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["audit_lines", "code_sections", "review_groups"])
def test_lines_at_the_edges_of_words(spark, tmp_path, name):
    """Letters of other scripts are parts of words, for the operators and for their SQL."""
    words = ["doi", "2001", "class", "return", "importó", "intérêt", "et al.é", "et al.", "claſs", "f(x", "éf(x", "DOI", "参考文献", "参考文献列表", "12. x", "[Q]"]
    lines = [a + w + b for w in words for a in ("", "ñ", "Osque ñ", "年", "x ", "_") for b in ("", "é", "年", " y", "_")]
    texts = ["\n".join(lines[k:] + lines[:k]) for k in range(0, 48)] + [f"\x0b{x}\x0b" for x in lines]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({ORACLE[name]}) x").fetchall()
    got = sorted(tuple(plain(v) for v in r) for r in df.collect())
    assert got == sorted(tuple(plain(v) for v in r) for r in want) and got
    if name == "audit_lines":
        assert any(r.line.endswith("ñdoi") for r in df.collect()) and not any(r.line.endswith("x doi") for r in df.collect())
