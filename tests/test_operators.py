"""Operators on small rows made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quillsieve.functions.rules import Rule, apply_rules
from quillsieve.operators import chunks, citations, issues, lines, packs, report, retrieval, sequences, structure, vectors
from quillsieve.plans.audit import PROSE_PACKS, audit, review, scores
from quillsieve.sources.ingest import heading_level, number_of, paper_text, read_parsed, references_of, sections_of, table_rows_of, upsert_papers


def test_text_rules_by_hand(spark):
    rows = [(1, "Abstract:text"), (2, "Keywords:a;b; c"), (3, "Zhang. D]. x"), (4, "Li. [[J]. y"), (5, "结果的的确"), (6, "abc，def"), (7, "ISBN abc，"), (8, "see Fig. 3"), (9, "basically fine"), (10, "参考文献 [1] x"), (11, "[1] Smith D]. 2020"), (12, None)]
    got = {}
    for r in apply_rules(spark.createDataFrame(rows, "id int, text string"), packs.TEXT_RULES, ["id"]).collect():
        got.setdefault(r.id, set()).add(r.rule_id)
    assert got == {1: {"FORMAT-004"}, 2: {"FORMAT-006", "FORMAT-005"}, 3: {"REF-002"}, 4: {"REF-003"}, 5: {"TYPO-001"}, 6: {"FORMAT-001"}, 8: {"FORMAT-002"}, 9: {"STYLE-001"}, 10: {"REF-001"}, 11: {"REF-002", "REF-004"}}


def test_areas_and_null_predicates(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "id int, x double")
    rules = [Rule("A", 9, "x > 1", "one"), Rule("B", 0, "x > 1", "two")]
    assert [tuple(r) for r in apply_rules(df, rules, ["id"]).orderBy("rule_id").collect()] == [(2, "A", 5), (2, "B", 1)]
    assert [tuple(r) for r in apply_rules(df, rules, ["id"], ("two",)).collect()] == [(2, "B", 1)]
    assert apply_rules(df, rules, ["id"], ()).count() == 0


@pytest.mark.parametrize("raw,rules", [
    ("[1] ZHANG S, LI W. Title[J]. Nature, 2030, 3(2): 1-9.", {"ERR_REF_JOURNAL_YEAR_EXCEED"}),
    ("[1] ZHANG S，LI W. Title[J]. Nature, 2010, 3(2): 1-9. doi:10.1/2099", {"ERR_REF_JOURNAL_FULL_COMMA"}),
    ("[2] WANG Q. Book[M]. Beijing: Press, 1850.", {"ERR_REF_MONO_YEAR_EARLY"}),
    ("[3] LIU Y. Work[D]. Somewhere, 2010.", {"ERR_REF_THESIS_NO_UNIVERSITY"}),
    ("[4] LIU Y. Talk[C]. Proceedings of X. Paris, 2010.", set()),
])
def test_bibliography_rules(spark, raw, rules):
    df = citations.with_parts(spark.createDataFrame([(1, 1, "[1]", raw)], "doc_id long, ref_pos int, ref_id string, raw_text string"))
    assert {r.rule_id for r in apply_rules(df, packs.REFERENCE_RULES, ["doc_id"]).collect()} == rules


@pytest.mark.parametrize("raw,facts,rules", [
    ("[1] A B. Work in 1990[J]. Nature, 2030, 3(2): 1-9", ("J", 1, 1990, 2030), {"REF-J-007"}),
    ("[1] A B. Work[J]. Nature, 2010, 3(2): 1023-1030", ("J", 1, 1023, 2010), {"REF-J-009"}),
    ("[1] A B; C D；E F、G H. Work[J]. Nature, 2010, 3(2): 1-9, 12345", ("J", 4, 2010, 2010), {"REF-J-006"}),
    ("[1] A B, C D, ; . Book[M]. Press, 2001-1899", ("M", 2, 1899, 2001), {"REF-M-001"}),
    ("no head", (None, 1, None, None), set()),
])
def test_reference_facts_by_hand(spark, raw, facts, rules):
    df = citations.reference_facts(spark.createDataFrame([(1, 1, "[1]", raw)], "doc_id long, ref_pos int, ref_id string, raw_text string"))
    r = df.first()
    assert (r.kind, r.authors, r.year_min, r.year_max) == facts
    assert {r.rule_id for r in apply_rules(df, packs.REFERENCE_LINE_RULES, ["doc_id"]).collect()} == rules


def test_citations_by_hand(spark):
    cites = spark.createDataFrame([(1, 1, "a [1] b"), (1, 2, "[3-5]"), (1, 3, "[2,7] x [4] y"), (2, 1, "none"), (1, 4, "[9-8]")], "doc_id long, pos int, text string")
    refs = spark.createDataFrame([(1, k, f"[{k}]", "x") for k in (1, 2, 3, 10)], "doc_id long, ref_pos int, ref_id string, raw_text string")
    groups = citations.citation_groups(cites)
    edges = citations.citation_edges(groups)
    assert sorted((r.pos, r.number) for r in edges.collect()) == [(1, 1), (2, 3), (2, 4), (2, 5), (3, 2), (3, 4), (3, 7), (4, 8), (4, 9)]
    assert [r.numbers for r in citations.missing_references(edges, refs).collect()] == ["4,5,7,8,9"]
    assert [r.numbers for r in citations.unused_references(edges, refs).collect()] == ["10"]
    both = {(r.number, r.rule_id) for r in citations.bidirectional_references(edges, refs).collect()}
    assert both == {(n, "REF_MISSING_001") for n in (4, 5, 7, 8, 9)} | {(10, "REF_UNUSED_001")}
    assert [(r.pos, r.before) for r in citations.citation_order(groups).collect()] == [(3, 5)]


def test_citation_lists_by_hand(spark):
    texts = ["x [1,2,3]", "[1 2 3]", "[1,3-5]", "[ 1 ] and [1 2]", "[1 - 3]", "[7, 9–11 ,2]", "[99999999999] [a1] [,1] [2-]"]
    cites = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, pos int, text string")
    refs = spark.createDataFrame([(1, k, f"[{k}]", "x") for k in (2, 3, 4, 12)], "doc_id long, ref_pos int, ref_id string, raw_text string")
    groups = citations.citation_groups(cites)
    edges = citations.citation_edges(groups)
    got = {}
    for r in edges.collect():
        got.setdefault(r.pos, []).append(r.number)
    assert {k: sorted(v) for k, v in got.items()} == {0: [1, 2, 3], 1: [1, 2, 3], 2: [1, 3, 4, 5], 3: [1, 1, 2], 4: [1, 2, 3], 5: [2, 7, 9, 10, 11]}
    assert {(r.pos, r.ord): (r.first_number, r.last_number, r.joint) for r in groups.where("pos < 6").collect()} == {(0, 0): (1, 3, ","), (1, 0): (1, 3, " "), (2, 0): (1, 5, ","), (3, 0): (1, 1, ""), (3, 1): (1, 2, " "), (4, 0): (1, 3, "-"), (5, 0): (2, 11, ",")}
    assert [r.numbers for r in citations.missing_references(edges, refs).collect()] == ["1,5,7,9,10,11"]
    assert [r.ref_id for r in citations.unused_entries(edges, refs).collect()] == ["[12]"]
    assert [(r.pos, r.number) for r in citations.missing_entries(groups, refs).collect()] == [(3, 1)]


def test_headings_by_hand(spark):
    rows = [(1, k, k + 1, "heading", lv, f"{k + 1} t") for k, lv in enumerate([1, 3, 2, 4, 1])]
    df = spark.createDataFrame(rows, "doc_id long, pos int, section_id int, type string, level int, text string")
    assert {r.pos for r in sequences.heading_jumps(df).collect()} == {1, 3}
    assert {r.pos for r in sequences.heading_reversals(df).collect()} == {4}


def test_chunks_put_together_again(spark):
    text = "".join(chr(97 + k % 26) for k in range(2345)) + "é😀"
    for size, overlap in ((800, 100), (10, 3), (7, 7), (5, 9), (5000, 10)):
        rows = chunks.overlapping_chunks(size, overlap)(spark.createDataFrame([(1, 0, text), (2, 0, "")], "doc_id long, pos int, text string")).orderBy("k").collect()
        step = size - overlap if overlap < size else size
        assert "".join(r.chunk[:step] for r in rows[:-1]) + rows[-1].chunk == text
        assert all(len(r.chunk) <= size for r in rows)


def test_near_duplicates_of_issues(spark):
    rows = [(1, "f", "x", 0, 10, 15), (1, "f", "x", 1, 12, 17), (1, "f", "x", 2, 15, 20), (1, "f", "y", 3, None, None), (1, "f", "y", 4, 3, 9), (2, "f", "x", 5, 10, 15)]
    df = spark.createDataFrame(rows, "doc_id long, issue_type string, label string, at long, start_char int, end_char int")
    once = issues.near_distinct_issues(df, ["doc_id"])
    assert sorted(r.at for r in once.collect()) == [0, 2, 3, 5]
    assert sorted(r.at for r in issues.near_distinct_issues(once, ["doc_id"]).collect()) == [0, 2, 3, 5]


def test_reviews_merged_without_near_copies(spark):
    """In chunk 0 the second reviewer's issue at 12 goes to the first's at 10, that at 14 stays; in the section chunk 1's at 13 goes."""
    schema = "doc_id long, section_id int, chunk int, at long, issue_type string, label string, start_char int, end_char int"
    first = spark.createDataFrame([(1, 1, 0, 5, "f", "x", 10, 15), (1, 1, 1, 1, "f", "x", 13, 18), (1, 1, 1, 2, "f", "y", None, None), (1, 2, 3, 0, "f", "x", 10, 15)], schema)
    second = spark.createDataFrame([(1, 1, 0, 0, "f", "x", 12, 17), (1, 1, 0, 1, "f", "x", 16, 21), (1, 1, 1, 0, "f", "y", 3, 9), (1, 1, 1, 1, "g", "y", 3, 9)], schema)
    got = sorted((r.section_id, r.chunk, r.source, r["at"], r.issue_type) for r in issues.near_merged_reviews(first, second).collect())
    assert got == [(1, 0, 0, 5, "f"), (1, 0, 1, 1, "f"), (1, 1, 0, 2, "f"), (1, 1, 1, 1, "g"), (2, 3, 0, 0, "f")]
    assert issues.near_merged_reviews(first.limit(0), second.limit(0)).count() == 0


def test_caption_numbers_by_hand(spark):
    """Numbers of captions first, then those of texts; each chapter counts by itself."""
    rows = [(0, "1.1", None), (1, "", "见图 1.2 与图 1.9"), (2, None, "Figure 1"), (3, " 2 ", "图 7"), (4, None, "Table 4. x"), (5, "x5", "表 5"), (6, "1.4", "图 1.3"), (7, "99999999999", None), (8, None, None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, pos int, caption string, text string")
    got = {(r.pos, r.chapter, r.n, r.expected) for r in sequences.caption_sequence(df).collect()}
    assert got == {(5, 0, 5, 3), (6, 1, 4, 3)}


def test_metadata_and_chapters_by_hand(spark):
    rows = [(1, "heading", "摘要 a", None, None, False), (1, "paragraph", "结论 b c", 2, None, True), (1, "table", "", 2, 4, None), (2, "paragraph", "x", 1, 1, None), (3, "heading", None, None, None, None)]
    df = spark.createDataFrame([(*r, "more") for r in rows], "doc_id long, type string, text string, page_start int, page_end int, has_math boolean, word string")
    got = {r.doc_id: (r.total_pages, r.page_mode, r.has_math, r.total_tables) for r in structure.document_metadata(df).collect()}
    assert got == {1: (4, "explicit_or_mixed", True, 1), 2: (1, "estimated", False, 0), 3: (1, "estimated", False, 0)}
    lacks = sorted((r.doc_id, r.rule_id[18:]) for r in structure.missing_chapters(df, ["摘要", "结论"]).collect())
    assert lacks == [(1, "结论"), (2, "摘要"), (2, "结论"), (3, "摘要"), (3, "结论")]


def test_heading_spacing_by_hand(spark):
    """Blank sections and tables don't follow a heading; its own spacing goes first; a blank heading and the last one are left out."""
    rows = [(0, "heading", "a", None, None), (1, "paragraph", " ", 5.0, None), (2, "table", "t", 5.0, None), (3, "paragraph", "b", 9.0, None), (4, "heading", "c", None, 5.0), (5, "paragraph", "d", 0.0, None), (6, "heading", "", None, 1.0), (7, "paragraph", "e", 1.0, None), (8, "heading", "f", None, 1.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, pos int, type string, text string, space_before double, space_after double")
    assert sorted((r.pos, r.rule_id) for r in sequences.heading_spacing(df).collect()) == [(0, "SPACE-002"), (5, "FMT_SPACING_001")]


def test_table_rows(spark, tmp_path):
    placed = {"is_table": True, "table_rows": [["a"], ["b"]], "table_row_positions": [{"row_index": 0, "cells": ["a"], "page_start": 2, "page_end": 2}, {"row_index": 1, "cells": ["b"], "page_start": 2, "page_end": 3}]}
    plain = {"is_table": True, "table_rows": [["c", None], []], "position": {"page_start": 4, "page_end": 5}}
    (tmp_path / "p.json").write_text(json.dumps({"doc_id": "x", "sections": [placed, plain, {"text": "t"}, {"table_rows": [["d"]]}]}))
    got = [tuple(r) for r in table_rows_of(read_parsed(spark, str(tmp_path / "p.json"))).orderBy("pos", "row_index").collect()]
    assert got == [("x", 0, 0, ["a"], 2, 2, False), ("x", 0, 1, ["b"], 2, 3, True), ("x", 1, 0, ["c", None], 4, 5, True), ("x", 1, 1, [], 4, 5, True), ("x", 3, 0, ["d"], None, None, False)]


def test_captions_pass_code_over(spark):
    rows = [(1, 0, "paragraph", "表 1 a", None, 0), (1, 1, "paragraph", "# note", None, 0), (1, 2, "table", "t", 1, 9), (1, 3, "paragraph", "续表 1", None, 0), (1, 4, "table", "t", 1, 20), (1, 5, "table", "t", 2, 20), (1, 6, "figure", "f", None, 0)]
    sections = spark.createDataFrame([(d, p, t, x, "SimSun", 1, e, n) for d, p, t, x, e, n in rows], "doc_id long, pos int, type string, text string, font string, page_start int, page_end int, row_count int")
    got = sorted((r.pos, r.rule_id) for r in PROSE_PACKS["captions"]({"sections": sections}).collect())
    assert got == [(4, "TABLE-CAPTION-001"), (5, "TABLE-CAPTION-001"), (5, "TABLE-CONT-001"), (6, "IMAGE-CAPTION-001")]


def test_ingest(spark, tmp_path):
    section = {"id": 4, "element_type": "Paragraph", "raw_text": "", "text": "1. Intro", "formatting": {"size": "18pt", "font": "SimHei"}, "props": {"a": "b"}}
    table = {"id": 5, "is_table": True, "table_rows": [["a", None], ["c", "d", "e"]]}
    lines = [{"doc_id": "x", "data": {"sections": [section, table], "references": [{"index": 3, "text": "t"}, {"id": "[7]", "raw_text": "r"}, {"raw_text": "q"}]}}, {"doc_id": "y", "sections": [{"raw_text": "（一） b"}]}]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(x) for x in lines))
    parsed = read_parsed(spark, str(tmp_path / "p.json"))
    got = {(r.doc_id, r.pos): r for r in sections_of(parsed).collect()}
    a, b, c = got["x", 0], got["x", 1], got["y", 0]
    assert (a.section_id, a.type, a.level, a.text, a.size_pt, a.props["font_family"], a.props["a"]) == (4, "heading", 1, "1. Intro", 18.0, "SimHei", "b")
    assert (b.type, b.text, b.row_count, b.column_count) == ("table", "a\t\nc\td\te", 2, 3)
    assert (c.type, c.level, c.section_id) == ("heading", 2, 1)
    assert sorted((r.ref_pos, r.ref_id, r.raw_text) for r in references_of(parsed).collect()) == [(1, "[3]", "t"), (2, "[7]", "r"), (3, "[3]", "q")]


def test_columns_of_text(spark):
    df = spark.createDataFrame([("Heading 2", "x"), ("", "第二章 y"), (None, "1.2.3. z"), ("标题3", ""), (None, "plain")], "s string, t string")
    assert [r.v for r in df.select(heading_level(F.col("s"), F.col("t")).alias("v")).collect()] == [2, 1, 3, 3, None]
    assert spark.range(1).select(number_of(F.lit("a 12.5 pt")), number_of(F.lit("none"))).first() == (12.5, None)


def test_papers(spark):
    schema = "paper_id string, document string, ingested_at int"
    out = upsert_papers(spark.createDataFrame([("a", "old", 1), ("", "z", 1)], schema), spark.createDataFrame([("a", "new", 2), (None, "z", 3)], schema)).collect()
    assert sorted((r.document, r.ingested_at) for r in out) == [("new", 2), ("z", 3)]
    text = paper_text(F.lit("T"), F.array(F.lit("A"), F.lit("B")), F.lit(""), F.lit(2001), F.lit(None), F.lit(None), F.lit("abs"))
    assert spark.range(1).select(text).first()[0] == "T\nA, B\n2001\nabs"


def test_verification_by_hand(spark):
    long = " ".join(f"word{k}" for k in range(60))
    papers = spark.createDataFrame(
        [(1, "Deep rules for audits", "Zhao Lin, Wu Ke", "Nature", 2003, "10.1/77", long), (2, "Of water", "B", None, 2001, None, "short text"), (3, None, None, None, None, None, "one two three four"), (4, None, None, None, 2010, None, "four three two one zero")],
        "paper_id long, title string, authors string, journal string, year int, doi string, document string",
    )
    texts = ["Li. Deep rules, for audits. 2003", "LI Y. deep RULES for audits and more, 1999", "four one", "Deep rules of things, in water audits", "zzz", "", None, "Zhao Lin, Wu Ke", "x, deep rules for, y 10.1/77"]
    queries = spark.createDataFrame([(k, t, "1999" if t and "1999" in t else "") for k, t in enumerate(texts)], "id long, text string, years string")
    want = sorted(tuple(r) for r in retrieval.paper_topk_all_pairs(queries, papers).collect())
    assert sorted(tuple(r) for r in retrieval.paper_topk(queries, papers).collect()) == want
    assert [r[1] for r in want if r[0] == 2] == [3, 4]  # under three tokens, another order
    got = {r.id: r for r in retrieval.verify(queries, retrieval.paper_topk(queries, papers), papers).collect()}
    assert (got[0].verdict, got[0].paper_id, got[0].title_score) == ("verified", 1, 1.0)
    assert (got[1].verdict, got[1].year_mismatch, got[1].title_score) == ("unverified", True, 1.0)
    assert {k: (r.reason, r.risk_flags) for k, r in got.items() if k in (0, 1, 3, 4, 5, 6)} == {
        0: ("local_match_strong", ""), 1: ("local_match_weak", "weak_match,year_mismatch"), 3: ("local_match_weak", "weak_match"), 4: ("no_local_match", "no_local_match"), 5: ("empty_reference", "empty_reference"), 6: ("empty_reference", "empty_reference")
    }
    assert (got[7].verdict, got[7].author_score) == ("verified", 1.0)
    assert (got[8].paper_id, got[8].title_score) == (1, 1.0)  # a fragment is the title's beginning
    assert all(got[k].no_candidate and got[k].score == 0 for k in (4, 5, 6)) and len(got) == len(texts)


def test_review_modes(spark):
    df = spark.createDataFrame([(1, 0, 1, "heading", 1, "9 basically", 11.0, "Arial", 1.0, 0.0), (1, 1, 2, "paragraph", 0, "a long enough paragraph", 12.0, "SimSun", 1.5, 2.0)], "doc_id long, pos int, section_id int, type string, level int, text string, size_pt double, font string, line_spacing double, first_line_indent double")
    other = lambda s: s.select("doc_id", "pos", F.lit("X").alias("rule_id"), F.lit(1).alias("severity"))
    hybrid = review({"sections": df}, "hybrid", other)
    assert {r.pos for r in hybrid.where("pack = 'reviewer'").collect()} == {1}
    assert {r.rule_id for r in review({"sections": df}, "local", other).collect()} == {"STYLE-001", "X"}
    assert scores(audit({"sections": df})).first().score > 0
    assert {r.rule_id for r in audit({"sections": df}, use=["mine"], more={"mine": lambda t: other(t["sections"])}).collect()} == {"X"}


def test_styles_of_long_chains_and_cycles(spark):
    rows = [(1, f"s{k}", f"s{k + 1}", None, float(k) if k % 20 == 7 else None) for k in range(50)] + [(1, "s50", "none", "Song", 99.0)]
    rows += [(2, "a", "b", None, None), (2, "b", "c", None, 3.0), (2, "c", "a", "Hei", None), (3, "x", "x", None, None), (3, "y", None, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, style_id string, parent string, font string, size_pt double")
    got = {(r.doc_id, r.style_id): (r.font, r.size_pt) for r in structure.style_inheritance(df).collect()}
    assert len(got) == len(rows) and all(got[1, f"s{k}"] == ("Song", next((float(j) for j in (7, 27, 47) if j >= k), 99.0)) for k in range(51))
    assert [got[2, x] for x in "abc"] == [("Hei", 3.0), ("Hei", 3.0), ("Hei", 3.0)] and (got[3, "x"], got[3, "y"]) == ((None, None), (None, 1.0))
    assert structure.style_inheritance(df.limit(0)).count() == 0


def test_equal_vectors_go_by_id(spark):
    rows = [(k, [1.0, 2.0]) for k in range(1000)] + [(2000, None), (2001, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(map(tuple, vectors.vector_topk(df, df.where("vec_id in (1, 50)")).collect()))
    assert got == [(1, 0, 1, 1.0), (1, 2, 2, 1.0), (1, 3, 3, 1.0), (50, 0, 1, 1.0), (50, 1, 2, 1.0), (50, 2, 3, 1.0)]


def test_reference_blocks_by_hand(spark):
    def block(*after):
        rows = [(1, 0, "paragraph", "before", None, 12.0, False), (1, 1, "paragraph", "：参考文献：", None, 12.0, False), *[(1, k + 2, *r) for k, r in enumerate(after)]]
        df = spark.createDataFrame(rows, "doc_id long, pos int, type string, text string, style string, size_pt double, bold boolean")
        return [r.text for r in structure.reference_block(df, spark.createDataFrame([("参考文献",)], "title string")).orderBy("pos").collect()]

    entry = ("paragraph", "[1] Smith J. 2001.", None, 16.0, True)
    other = ("paragraph", "[2] " + "x" * 40, None, 12.0, False)
    assert block(entry, other) == [entry[1], other[1]]
    assert block(entry, ("paragraph", "附录 A", None, 12.0, False), other) == [entry[1]]
    assert block(entry, ("table", "t" * 50, None, 12.0, False), other) == [entry[1]]
    for end in (("paragraph", "Figures", None, 14.0, False), ("paragraph", "Figures", None, 12.0, True), ("paragraph", "a. b", "Heading 2", 10.0, False)):
        assert block(entry, end, other) == [entry[1]]
    for on in (("paragraph", "Figures", None, 13.0, False), ("paragraph", "Figures", None, 11.0, True), ("paragraph", "F" * 31, None, 20.0, True)):
        assert len(block(entry, on, other)) == 3


def test_code_and_lines_by_hand(spark):
    texts = [("int x = 1;", None), ("plain words here", "Courier New"), ("plain words here", None), ("// 注释", None), ("a(b)\nc(d)\nwords", None), ("a(b)\nwords\nwords", None), ("see ``` here", None), (" ", None), (None, None), ("# 标题", None), ("中文；调用 f(x)", None), ("f(x) # 中文", None), ("f(x) 中 # 中文", None)]
    df = spark.createDataFrame([(1, k, t, f) for k, (t, f) in enumerate(texts)], "doc_id long, pos int, text string, font string")
    assert [r.is_code for r in lines.code_sections(df).orderBy("pos").collect()] == [True, True, False, False, True, False, True, False, False, True, False, True, False]
    assert lines.prose(df).count() == 7
    kept = lines.audit_lines(spark.createDataFrame([(1, 0, "正文 CNN\r\n[3] A. Title[J]. 2001\n  1. item\nfoo(bar)\n\n使用图形处理器（GPU）与 GPU、 BERT", None)], df.schema))
    assert [(r.n, r.line) for r in kept.orderBy("n").collect()] == [(0, "正文 CNN"), (4, "使用图形处理器（GPU）与 GPU、 BERT")]
    assert sorted(r.abbreviation for r in lines.undefined_abbreviations(kept).collect()) == ["BERT", "CNN"]
    english = spark.createDataFrame([(1, 0, "uses CNN", None)], df.schema)
    assert lines.undefined_abbreviations(lines.audit_lines(english)).count() == 0


def test_places_times_and_sentinels_by_hand(spark):
    rows = [(1, 0, "abcabc", "ca"), (1, 1, "abc", "zzzz"), (1, 2, "", "a"), (1, 3, None, "a"), (1, 4, "a", ""), (1, 5, "😀é", "é")]
    got = lines.needle_positions(spark.createDataFrame(rows, "doc_id long, pos int, text string, needle string")).orderBy("pos").collect()
    assert [(r.start_char, r.end_char) for r in got] == [(2, 4), (0, 3), (0, 0), (0, 0), (0, 0), (1, 2)]
    times = spark.createDataFrame([("2024-12-31T20:00:00",), ("2024-01-01T00:00:00-05:00",), ("no time",), (None,)], "t string")
    assert [r.x for r in times.select(lines.utc8(F.col("t")).alias("x")).collect()] == ["2025-01-01 04:00:00+08:00", "2024-01-01 13:00:00+08:00", None, None]
    nested = spark.createDataFrame([(1, {"a": "unknown", "b": 'x:"unknown",'}, ["unknown", "no"]), (1, {}, []), (2, {"unknown": "x"}, None)], "id long, m map<string,string>, l array<string>")
    assert {r.id: r.n for r in lines.sentinel_counts(nested, "id").collect()} == {1: 2, 2: 0}


def test_report_views_by_hand(spark):
    rows = [(1, 0, "local_issues", 1, "a"), (1, 0, "local_issues", 2, "a"), (1, 0, "llm_issues", 3, "b"), (1, 1, "issues", 1, "a"), (1, 1, "local_issues", 2, "a"), (1, 1, "llm_issues", 3, "c"), (2, 0, "llm_issues", 1, None)]
    out = report.compact_views(spark.createDataFrame(rows, "doc_id long, chunk int, view string, seq int, rule string"), ["rule"]).collect()
    assert sorted((r.doc_id, r.chunk, r.view, r.n, r.entries) for r in out) == [(1, 0, "issues", 2, "a;b"), (1, 0, "llm_issues", 1, "b"), (1, 0, "local_issues", 1, "a"), (1, 1, "issues", 1, "a"), (1, 1, "llm_issues", 1, "c"), (2, 0, "issues", 1, "")]


@pytest.mark.parametrize("ref_id,raw,rules", [
    ("[1]", "[1] ZHANG S. Title[J]. Nature, 1998, 2030, 3(2): 1-9.", {"ERR_REF_JOURNAL_YEAR_EXCEED"}),
    ("[1]", "[1] ZHANG S. Title[J]. Nature, 2010 (2030), 2301.12345, 3(2): 1-9.", set()),
    ("[1]", "[1] ZHANG S. Title[J]. Nature, 1950, 1850, 3(2): 1-9.", {"ERR_REF_JOURNAL_YEAR_EARLY"}),
    ("[1]", "[1] WANG Q. Book[M]. Beijing, 1998, 2030, Press: 3.", {"ERR_REF_MONO_YEAR_EXCEED"}),
    ("[1]", "[1] WANG Q. Book[M]. Beijing, ISBN 2030, Press: 3.", set()),
    ("[1]", "[1] WANG Q. Book[M]. Beijing: Press, 1950, 1850.", {"ERR_REF_MONO_YEAR_EARLY"}),
    ("[1]", "[1] LIU Y. Work[D]. Some University, ISBN 2030.", {"ERR_REF_MONO_YEAR_EXCEED"}),
    ("[x]", "[x] ZHANG S. Title[J]. Nature, 2030.", set()),
    ("[99999999999]", "[1] LIU Y. Work[D]. Nowhere.", set()),
    (None, "[1] LIU Y. Work[D]. Nowhere.", set()),
])
def test_years_and_numbers_of_entries(spark, ref_id, raw, rules):
    df = citations.with_parts(spark.createDataFrame([(1, 1, ref_id, raw)], "doc_id long, ref_pos int, ref_id string, raw_text string"))
    assert {r.rule_id for r in apply_rules(df, packs.REFERENCE_RULES, ["doc_id"]).collect()} == rules


def test_reference_numbers(spark):
    ids = {"[7]": 7, " [ 12 ] ": 12, "[abc]": 0, "[99999999999]": 0, "[2147483648]": 0, "": 0, "[-3]": -3, "[1.0]": 0, None: 0, "+4": 4}
    df = spark.createDataFrame([(k,) for k in ids], "ref_id string")
    assert {r[0]: r[1] for r in df.select("ref_id", citations.reference_number(F.col("ref_id"))).collect()} == ids
    refs = spark.createDataFrame([(1, k + 1, i, t) for k, (i, t) in enumerate([("[abc]", "no number"), ("[99999999999]", None), ("[11]", "[10] x"), ("[2]", "y"), ("[3]", "z")])], "doc_id long, ref_pos int, ref_id string, raw_text string")
    edges = spark.createDataFrame([(1, k, n) for k, n in enumerate([12, 2, 1, 3, 2, 0])], "doc_id long, pos int, number int")
    assert [r.numbers for r in citations.missing_references(edges, refs).collect()] == ["1,12"]
    assert [r.numbers for r in citations.unused_references(edges, refs).collect()] == ["10"]
    assert {(r.number, r.rule_id) for r in citations.bidirectional_references(edges, refs).collect()} == {(1, "REF_MISSING_001"), (12, "REF_MISSING_001"), (10, "REF_UNUSED_001")}
    assert [(r.ref_pos, r.number) for r in citations.reference_numbering(refs).collect()] == [(1, 0)]
    assert citations.reference_order(edges, refs).count() == 0
    assert [r.out_of_place for r in citations.reference_order(edges, refs.withColumn("ref_pos", -F.col("ref_pos"))).collect()] == [2]
    assert citations.missing_references(edges.limit(0), refs).count() == citations.bidirectional_references(edges.limit(0), refs.limit(0)).count() == 0
