"""Containment, places of references and sections, mentions of charts, by hand and against plain Python."""

import random

import pytest

from quillsieve.operators import contained, placement, structure
from quillsieve.operators.contained import contained_in


@pytest.mark.parametrize("texts, needles", [(64, 4096), (2, 3)])
def test_contained_in_equals_plain(spark, monkeypatch, texts, needles):
    monkeypatch.setattr(contained, "_TEXTS", texts)
    monkeypatch.setattr(contained, "_NEEDLES", needles)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé图 ") for _ in range(n))
    n = [(rng.randint(1, 5), k, rng.choice([None, "", word(1), word(2), word(3)])) for k in range(120)] + [(None, 500, "a"), (1, 501, "a"), (1, 502, "a")]
    t = [(rng.randint(1, 6), k, rng.choice([None, "", word(5), word(40)])) for k in range(60)] + [(None, 500, "a"), (2, 501, word(3000))]
    want = sorted((d, i, j) for d, i, s in n for e, j, x in t if d is not None and d == e and s and x and s in x)
    df = contained_in(spark.createDataFrame(n, "doc_id long, needle_id long, needle string").repartition(3), spark.createDataFrame(t, "doc_id long, text_id long, text string").repartition(3))
    assert sorted(map(tuple, df.collect())) == want
    assert contained_in(spark.createDataFrame(n, "doc_id long, needle_id long, needle string").limit(0), spark.createDataFrame(t, "doc_id long, text_id long, text string")).count() == 0


def pages(spark, sections, texts):
    s = spark.createDataFrame([(1, k, t, p) for k, (t, p) in enumerate(sections)], "doc_id long, pos int, text string, page int").repartition(3)
    return [(r.page, r.matched) for r in placement.section_pages(s, spark.createDataFrame(texts, "doc_id long, page int, text string").repartition(3)).orderBy("pos").collect()]


def test_pages_are_sought_forward_and_around(spark):
    book = [(1, 1, "Intro"), (1, 2, "second in tro"), (1, 3, "third"), (1, None, "lost"), (2, 1, "elsewhere")]
    assert pages(spark, [("intro", None), ("second", None), ("intro", None)], book) == [(1, True), (2, True), (2, True)]
    # from the last page back to the first, not found ones and blank ones do not move the place
    assert pages(spark, [("third", None), ("intro", 9), ("nowhere", 7), (" ", 5), (None, None), ("intro", None), ("lost", None), ("elsewhere", None)], book) == [(3, True), (1, True), (7, False), (5, False), (1, False), (1, True), (1, False), (1, False)]
    # several texts of one page, ties of one text on two pages
    assert pages(spark, [("b", None), ("a", None), ("b", None)], [(1, 2, "a"), (1, 2, "b"), (1, 1, "b")]) == [(1, True), (2, True), (2, True)]


def test_pages_of_many_documents_in_several_batches(spark):
    rng = random.Random(6)
    sections = [(d, k, rng.choice("abcdefgh"), None) for d in range(40) for k in range(rng.randint(1, 30))]
    texts = [(d, p, "".join(rng.choice("abcdefgh") for _ in range(4))) for d in range(0, 40) for p in range(1, 6)]
    want, last = {}, {}
    for d, k, t, _ in sections:
        own = [p for e, p, x in texts if e == d and t in x]
        page = next((p for p in own if p >= last.get(d, 0)), own[0] if own else None)
        last[d] = page or last.get(d, 0)
        want[d, k] = page or 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = placement.section_pages(spark.createDataFrame(sections, "doc_id long, pos int, text string, page int").repartition(5), spark.createDataFrame(texts, "doc_id long, page int, text string"))
        assert {(r.doc_id, r.pos): r.page for r in df.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_references_at_sections(spark):
    long = "x" * 119 + "yz"
    refs = spark.createDataFrame([(1, 1, "[1] A  book"), (1, 2, long + " tail"), (1, 3, "nowhere"), (1, 4, ""), (1, 5, None), (2, 1, "[1] A book")], "doc_id long, ref_pos int, raw_text string")
    sections = spark.createDataFrame([(1, 0, 10, "book"), (1, 1, 11, "see [1] a BOOK."), (1, 2, 12, long), (1, 3, 13, None), (1, 4, 14, ""), (1, 5, 15, "x" * 119 + "y other")], "doc_id long, pos int, section_id int, text string")
    assert sorted(map(tuple, placement.reference_sections(refs, sections).collect())) == [(1, 1, 10), (1, 2, 12)]


def test_mentions_of_charts(spark):
    charts = spark.createDataFrame([(1, 1, "1"), (1, 2, "3"), (1, 3, None), (1, 4, ""), (1, 5, "A1"), (2, 1, None), (3, 1, "2"), (1, 6, "7"), (1, 7, "8")], "doc_id long, pos int, caption_number string")
    paragraphs = spark.createDataFrame([(1, 1, "see 图12 and FIGURE 7"), (1, 2, None), (1, 3, "表A1, Table8"), (2, 9, "no word"), (3, 1, "figure  2")], "doc_id long, pos int, text string")
    assert sorted((r.doc_id, r.pos) for r in structure.unmentioned_charts(charts, paragraphs).collect()) == [(1, 2), (2, 1), (3, 1)]
