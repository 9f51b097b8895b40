"""Texts far beyond a block of the vectorised code, and columns that clash with those inside the operators."""

import pytest
from pyspark.sql import functions as F

from quillsieve.llm.decontaminate import find_contamination
from quillsieve.llm.langid import identify, train
from quillsieve.llm.licenses import scan_licenses
from quillsieve.llm.ngram_join import jaccard_classes
from quillsieve.llm.packing import pack
from quillsieve.llm.substring_dedup import remove_repeats

WORDS = 300_000


@pytest.fixture(scope="module")
def docs(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(WORDS)), lambda k: F.concat(F.lit("w"), k.cast("string"))), " ")
    one = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), text.alias("text"))
    two = spark.range(1).select(F.lit(2).cast("long").alias("doc_id"), F.concat(text, F.lit(" tail\nReleased under the MIT License.")).alias("text"))
    # names that the operators use themselves
    return one.unionByName(two).withColumns({c: F.lit(0) for c in ("n", "h", "key", "range", "spans", "leaf", "kind", "id", "a", "b", "sketch")})


def test_long_texts(spark, docs):
    assert {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_classes(docs).collect()} == {(1, WORDS - 4, 1, 1), (2, WORDS + 2, 1, 1)}
    assert {(r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(docs).collect()} == {(1, WORDS, 0), (2, WORDS + 6, WORDS)}
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(WORDS - 20, WORDS + 1))), (2, "w300000 tail released")], "item_id long, text string")
    assert {(r.doc_id, r.n_hit, r.n_items) for r in find_contamination(docs, items, shard=100_000).collect()} == {(1, 21, 1), (2, 23, 2)}
    assert {(r.doc_id, r.license) for r in scan_licenses(docs).collect()} == {(1, None), (2, "MIT")}
    pieces = pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(pieces) == 2 and all(r.n == r.m > WORDS for r in pieces)
    names, net = train(docs.withColumn("lang", F.when(F.col("doc_id") == 1, "x").otherwise("y")), steps=5)
    assert {r.doc_id for r in identify(docs, names, net).collect()} == {1, 2}
