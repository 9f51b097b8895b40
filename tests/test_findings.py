"""Full issue rows and outside reviewers by hand."""

from quillsieve.operators import findings
from quillsieve.operators.findings import CATALOGUE, Entry, text_issues
from quillsieve.plans.audit import review
from quillsieve.plans.reviewer import outside_issues, outside_reviewer


def test_rows_say_what_and_where(spark):
    text = "好的的，，\n  Keywords:a;b\nkeywords:c \x0bAbstract:x"
    rows = [(1, text), (2, None), (3, ""), (4, "BASICALLY ok"), (5, "[2] A b. 2001 D]. x\n[[J]. y"), (6, "abc，"), (7, "ISBN abc，")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, message string")
    got = {}
    for r in text_issues(df, ["doc_id"]).collect():
        got.setdefault(r.doc_id, []).append((r.rule_id, r.severity, r.original, r.start_char, r.end_char))
    at = text.index("Keywords:a;b")
    assert sorted(got[1]) == sorted([
        ("TYPO-001", 3, "的的", 1, 3), ("TYPO-001", 3, "，，", 3, 5), ("FORMAT-006", 2, "Keywords:a;b", at, at + 12), ("FORMAT-005", 2, "Keywords:a;b", at, at + 12),
        ("FORMAT-006", 2, "keywords:c", text.index("keywords:c"), text.index("keywords:c") + 10), ("FORMAT-004", 2, "Abstract:x", len(text) - 10, len(text)),
    ])
    assert got[4] == [("STYLE-001", 2, "basically", 0, 9)]
    assert sorted(r[0] for r in got[5]) == ["REF-002", "REF-003", "REF-004"] and got[6] == [("FORMAT-001", 2, None, None, None)] and set(got) == {1, 4, 5, 6}
    assert {r.rule_id for r in text_issues(df, ["doc_id"], areas=("typo",)).collect()} == {"TYPO-001"}
    assert text_issues(df.limit(0), ["doc_id"]).count() == 0 and text_issues(df, ["doc_id"], []).count() == 0


def test_a_catalogue_of_ones_own(spark):
    many = [Entry(f"N-{k}", "own", 9, "found", "", "needle", f"w{k}x") for k in range(3000)]
    df = spark.createDataFrame([(1, "w7x w70x w7x"), (2, "none")], "doc_id long, text string")
    got = [(r.rule_id, r.severity, r.suggestion, r.start_char) for r in text_issues(df, ["doc_id"], [*CATALOGUE, *many]).orderBy("start_char").collect()]
    assert got == [("N-7", 5, None, 0), ("N-70", 5, None, 4)]
    assert [k for k, *_ in findings.Matcher([Entry("A", "a", 1, "", "", "needle", "bc"), Entry("B", "a", 1, "", "", "needle", "abcd"), Entry("C", "a", 1, "", "", "needle", "bc")]).find("abcd")] == [0, 1, 2]


def _odd_reviewer():
    def call(chunks):
        """Fails for whole batches with a bad text, answers some wrongly."""
        if any("bad" in c["text"] for c in chunks):
            raise RuntimeError("no connection")
        if any("short" in c["text"] for c in chunks) and len(chunks) > 1:
            return []
        wrong = [{"rule_id": "X", "severity": "high"}, {"severity": 1}, "text", {"rule_id": "Y", "start_char": 1.5}, {"rule_id": True}]
        return [[*wrong, {"rule_id": "R", "severity": 9, "original": c["text"][-3:], "start_char": 0, "end_char": 1, "more": 1}, {"message": "m", "original": "absent", "start_char": 3, "end_char": 4}] if "none" not in c["text"] else None for c in chunks]

    return call


def test_a_failing_reviewer_loses_no_other_issue(spark):
    rows = [(1, k, t) for k, t in enumerate(["one two", "bad one", "short two", None, "", "none", "two two"])]
    df = spark.createDataFrame(rows, "doc_id long, pos int, text string").coalesce(1)
    for size in (1, 3, 16):
        got = sorted(((r.pos, r.rule_id or "", r.severity, r.original, r.start_char, r.end_char) for r in outside_issues(df, _odd_reviewer(), size).collect()), key=str)
        assert got == sorted([x for k, at in ((0, 4), (2, 6), (6, 0)) for x in ((k, "R", 5, "two", at, at + 3), (k, "", 1, "absent", None, None))], key=str)


def test_reviews_with_an_outside_reviewer(spark):
    df = spark.createDataFrame([(1, 0, 1, "heading", 1, "9 basically", 11.0, "Arial", 1.0, 0.0), (1, 1, 2, "paragraph", 0, "a long enough paragraph", 12.0, "SimSun", 1.5, 2.0)], "doc_id long, pos int, section_id int, type string, level int, text string, size_pt double, font string, line_spacing double, first_line_indent double")
    hybrid = review({"sections": df}, "hybrid", outside_reviewer(_odd_reviewer())).where("pack = 'reviewer'").collect()
    assert {(r.pos, r.rule_id) for r in hybrid} == {(1, "R"), (1, None)}
