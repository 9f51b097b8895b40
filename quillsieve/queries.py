"""Registered queries over the given tables, and the same in SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rules import Rule, apply_rules, rules_sql
from .functions.sql import SqlOperator, duck_sql, run
from .operators import chunks, citations, findings, issues, lines, packs, placement, report, retrieval, sequences, structure
from .operators import vectors as vector_index
from .plans.audit import PROSE_PACKS, audit, scores
from .plans.reviewer import outside_issues
from .sources.ingest import sizes_of
from .sources.scratch import Tables
from .sources.views import VIEWS, view, view_sql
from .streaming import status
from .streaming.jobs import latest_status, stage_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Inputs of queries that are derived from the views: SQL in both spellings.
DERIVED: dict[str, tuple[list[str], str]] = {
    "groups": (["cites"], citations.citation_groups.sql),
    "edges": (["groups"], citations.citation_edges.sql),
    "ref_facts": (["refs"], citations.reference_facts.sql),
    "flagged": (
        ["sections"],
        """select doc_id, pos, case when type = 'figure' and pos % 2 = 0 then 'formula' when type = 'figure' then 'image' when pos % 13 = 3 then 'list' else type end as type, text,
  case when pos % 3 = 0 then 'true' when pos % 3 = 1 then 'false' end as page_break, case when doc_id % 4 = 0 then 'true' end as continued, case doc_id % 3 when 0 then '0.9' when 1 then '0.5' end as confidence,
  case (doc_id + pos) % 4 when 0 then 'right' when 1 then 'center' when 2 then 'left' end as alignment, case when pos % 2 = 0 then 'false' else 'true' end as has_caption, case when doc_id % 2 = 0 then 'Table 1 continued' end as caption,
  case when doc_id % 3 = 0 then cast(pos % 3 as string) end as indent_level, case when doc_id % 5 = 0 then '0.5pt' else '0.5' end as list_indent, case doc_id % 3 when 0 then 'bottom-center' when 1 then 'top' end as page_number_at from {sections}""",
    ),
    "mathy": (["tabled"], "select doc_id, pos, type, text, case when doc_id % 3 > 0 then page_start end as page_start, case when doc_id % 3 = 1 and pos % 2 = 0 then page_end end as page_end, pos % 9 = 1 and doc_id % 2 = 0 as has_math from {tabled}"),
    "error_issues": (["issues"], "select doc_id, case when k < 2 then concat('ERR_', rule_id) else rule_id end as rule_id from {issues}"),
    "captions": (
        ["sections"],
        """select doc_id, pos, case when pos % 3 = 0 then null when doc_id % 2 = 0 then concat(cast(1 + pos % 2 as string), '.', cast(pos % 4 as string)) else cast(pos % 5 as string) end as caption,
  case pos % 5 when 0 then 'see 图 2.1 and 3' when 1 then 'Table 4. end' when 2 then 'Figure 3' when 3 then concat(text, ' 表1 x') else text end as text from {sections} where type in ('figure', 'table')""",
    ),
    "lines": (["sections"], "select doc_id, pos, case when (doc_id + pos) % 5 in (1, 2, 3) then ' ' else text end as text from {sections}"),
    "ref_lines": (["refs"], "select doc_id, ref_pos as pos, raw_text as text from {refs}"),
    "no_refs": (["refs"], "select doc_id from {refs} where doc_id % 3 = 0"),
    "spaced": (["sections"], "select doc_id, pos, type, case when (doc_id + pos) % 4 = 1 then ' ' else text end as text, case when pos % 3 = 0 then real(pos % 10) end as space_before, case when pos % 2 = 0 then real((doc_id + pos) % 12) end as space_after from {sections}"),
    "tabled": (["sections"], "select *, length(text) % 31 as row_count, cast(floor(pos / 6) as int) as page_start, cast(floor((pos + doc_id % 2) / 6) as int) as page_end from {sections}"),
    "indented": (["sections"], "select doc_id, pos, case when pos % 4 = 0 then concat('1. ', text) when pos % 4 = 1 then concat('（二）', text) else text end as text, case when pos % 3 = 0 then 'List Bullet 2' when pos % 3 = 1 then 'Normal' end as style, cast((doc_id + pos) % 5 as double) / 4 as left_indent from {sections}"),
    "paged": (["sections"], "select doc_id, pos, pos % 7 = 3 and doc_id % 2 = 0 as page_break, case when (doc_id + pos) % 3 = 0 then size_pt end as size_pt, cast(floor(pos / 4) as int) as page from {sections}"),
    "charts": (["sections"], "select doc_id, pos, case when pos % 2 = 0 then cast(pos % 10 as string) end as caption_number from {sections} where type in ('table', 'figure')"),
    "paragraphs": (["sections"], "select doc_id, pos, concat(text, case when pos % 3 = 0 then concat(' Figure ', cast(pos % 10 as string)) else '' end) as text from {sections} where type = 'paragraph'"),
    "known_issues": (["sections"], "select doc_id, section_id from {sections} where type = 'heading'"),
    "issues": (
        ["sections"],
        """select doc_id, section_id, pos, k, case (pos + k) % 6 when 0 then 'FORMAT-001' when 1 then 'REF-002' when 2 then 'CONSIST-003' when 3 then 'THESIS-FORMAT-001' when 4 then 'STYLE-001' else 'OTHER' end as rule_id,
  case (doc_id + pos * k) % 5 when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'medium' when 3 then 'LOW' else 'INFO' end as severity_name, cast((doc_id + k) % 8 - 1 as int) as raw_severity, cast((doc_id + pos) % 5 + 1 as int) as severity, case k % 2 when 0 then 'format' else 'logic' end as issue_type,
  case when pos % 3 = 0 then '' else substring(text, 1, 5) end as original, case when (pos + k) % 4 = 0 then null else cast((pos * 2) % 9 as int) end as start_char, case when (pos + k) % 4 = 0 then null else cast((pos * 2) % 9 + 5 + k % 2 as int) end as end_char,
  cast(floor(pos / 3) as int) as page, real(pos % 17) as y, real(100 + doc_id % 150) as height, substring(text, 1, 30) as message from {sections}, (values (0), (1), (2)) v(k) where (doc_id + pos + k) % 3 < 2""",
    ),
    "first": (["issues"], "select doc_id, section_id, rule_id, start_char from {issues} where k < 2"),
    "second": (["issues"], "select doc_id, case when doc_id % 7 = 0 then section_id + 1000 else section_id end as section_id, rule_id, start_char from {issues} where k > 0"),
    "packs": (["issues"], "select doc_id, section_id, rule_id from {issues} where k = 0"),
    "reviewed": (["issues"], "select doc_id, section_id, rule_id from {issues} where k = 1 and doc_id % 2 = 0"),
    "labelled": (["issues"], "select doc_id, issue_type, coalesce(nullif(original, ''), 'none') as label, section_id * 4 + k as at, start_char, end_char from {issues}"),
    "chunk_rows": (["sections"], chunks.overlapping_chunks(80, 10).sql),
    "code_lines": (["sections"], "select doc_id, pos, case when doc_id % 3 = 0 and pos % 5 < 4 then concat('def f(x): ', substring(text, 1, 5)) when pos % 9 = 1 then '# note' else text end as line from {sections}"),
    "texts": (["benchmark"], "select item_id as id, text from {benchmark}"),
    "text_pairs": (["benchmark"], "select a.item_id as id, a.text as a, concat(substring(a.text, 1, 60), ' ', b.text) as b from {benchmark} a join {benchmark} b on b.item_id = a.item_id + 1"),
    "line_queries": (["sections"], "select id, text, case when rx(text, «(?:19|20)[0-9]{2}») then cast(regexp_extract_all(text, «(?:19|20)[0-9]{2}», 0) as string) else '' end as years from (select doc_id * 10000 + pos as id, case when pos % 3 = 0 then concat(text, ' ', cast(1990 + doc_id % 30 as string)) else text end as text from {sections}) q"),
    "candidates": (["line_queries", "papers"], retrieval.paper_topk_all_pairs.sql.replace("{queries}", "{line_queries}")),
    "field_pairs": (["cells"], "select doc_id, section_id, table_index, row_index, col, name, replace(name, '*', '') as bare, name like '%*' as required, value from {cells}"),
    "repeated_ids": (["sections"], "select doc_id, pos, cast(floor(section_id / 2) as int) as section_id from {sections}"),
    "mentions": (["sections"], "select doc_id, pos, concat(text, case pos % 4 when 0 then ' Convolutional Network (CNN) and GPU' when 1 then ' CNN, LSTM' else '' end) as text from {sections}"),
}


#: Inputs that are made by an operator of DataFrame code; DERIVED has the oracle's SQL for them.
MADE = {"parts_of_refs": (["odd_refs"], citations.with_parts)}
_ODD_ID = "case (doc_id * 3 + ref_pos) % 23 when 1 then '[abc]' when 2 then '[99999999999]' when 3 then '[]' when 4 then '+7' when 5 then '[-2]' else ref_id end"
DERIVED |= {
    "odd_refs": (
        ["refs"],
        f"""select doc_id, ref_pos, {_ODD_ID} as ref_id, case when (doc_id + ref_pos) % 9 = 4 then replace(raw_text, ', 2030', ', 1998, 2030') when (doc_id + ref_pos) % 9 = 5 then concat(replace(raw_text, '. Brand', '. ISBN 2031, Brand'), ' 1850, 1950.')
  when (doc_id + ref_pos) % 9 = 6 then replace(raw_text, '. Brand', '. (2031) 2040.5, Brand') when (doc_id + ref_pos) % 9 = 7 then concat(raw_text, ' 1950, 1850, 2033, x') else raw_text end as raw_text from {{refs}}""",
    ),
    "listed_refs": (["refs"], f"select doc_id, ref_pos, {_ODD_ID} as ref_id, case when (doc_id + ref_pos) % 5 = 0 then concat('no number ', raw_text) else raw_text end as raw_text from {{refs}}"),
}


def _years_sql() -> str:
    """Parts of references for the oracle, years by going over all places of a text."""
    at = "from (select unnest(range(1, length({t}) - 2)) p) q where regexp_matches(substr({t}, p, 4), '^[0-9]{{4}}$')"
    near = "regexp_matches(substr(concat(' ', {t}), p, 1), '{before}') and regexp_matches(substr({t}, p + 4, 1), '{after}')"
    year = "cast(substr({t}, p, 4) as int)"
    whole = "(p = 1 or not regexp_matches(substr({t}, p - 1, 1), '[0-9(]')) and not regexp_matches(substr({t}, p + 4, 1), '[0-9]') and not regexp_matches(substr({t}, p + 4, 2), '^[.][0-9]')"
    delimited = "p > 1 and " + near.format(t="{t}", before=r"[,，\s]", after=r"[,，.\s:：]")
    some = lambda t, *tests: f"coalesce((select bool_or(true) {at} and {' and '.join(tests)}), false)".format(t=t)
    late, early = f"{year} between 2027 and 2099", f"{year} between 1000 and 1899"
    flags = {
        "journal_late": some("year_window", whole, late), "journal_early": some("year_window", delimited, early), "monograph_late": some("year_window", delimited, late, "not regexp_matches(substr({t}, greatest(1, p - 10), p - greatest(1, p - 10)), 'ISBN|isbn')"),
        "thesis_late": some("no_doi", delimited, late), "monograph_early": some("no_doi", delimited, early),
    }
    digits = "trim(replace(replace(ref_id, '[', ''), ']', ''))"
    return f"""select *, case when regexp_matches({digits}, '^[+-]?[0-9]+$') and abs(cast({digits} as hugeint)) < 2147483648 then cast({digits} as int) else 0 end ref_num, raw_text like '%[J]%' is_j, raw_text like '%[M]%' is_m, raw_text like '%[D]%' is_d, raw_text like '%[C]%' is_c,
  cast(len(list_filter(string_split(author, ''), lambda c: c in (',', '，'))) as int) author_commas, {', '.join(f'{v} {k}' for k, v in flags.items())}
from (select *, string_split(body, ':')[1] year_window, string_split(body, '. ')[1] author, case when instr(body, '. ') > 1 then string_split(body, '. ')[1] end first_segment
  from (select *, case when contains(no_doi, '] ') then substr(no_doi, instr(no_doi, '] ') + 2) else no_doi end body from (select doc_id, ref_pos, ref_id, raw_text, regexp_extract(raw_text, '(?is)^(.*?)(doi.*)?$', 1) no_doi from {{odd_refs}}) a) b) c"""


DERIVED["parts_of_refs"] = (["odd_refs"], _years_sql())


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in VIEWS:
        return view(spark, sf_dir, name)
    if name in MADE:
        inputs, op = MADE[name]
        return op(*[frame(spark, sf_dir, k) for k in inputs])
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs, sql = DERIVED[name]
    return run(sql, spark, **{k: frame(spark, sf_dir, k) for k in inputs})


def sources(names: list[str]) -> dict[str, str]:
    """SQL of the named inputs and what they need, in order, for the oracle."""
    out: dict[str, str] = {}
    for n in names:
        if n in VIEWS:
            out[n] = view_sql(n)
        elif n in DERIVED:
            inputs, sql = DERIVED[n]
            out |= sources(inputs)
            sql = duck_sql(sql)
            for k in inputs:
                sql = sql.replace("{" + k + "}", k)
            out[n] = sql
    return out


def add(name: str, op: SqlOperator, **given: str) -> None:
    """A query of an operator; given: which table, view or derived input stands for each of its inputs, if not the one of its name."""
    inputs = [given.get(k, k) for k in op.inputs]
    QUERIES[name] = lambda spark, sf_dir: op(*[frame(spark, sf_dir, k) for k in inputs])
    ORACLE[name] = op.oracle(sources(inputs), inputs)


def add_rules(name: str, rules: list[Rule], source: str, keys: list[str], areas: tuple[str, ...] | None = None, prepare: str = "select * from {x}") -> None:
    QUERIES[name] = lambda spark, sf_dir: apply_rules(run(prepare, spark, x=frame(spark, sf_dir, source)), rules, keys, areas)
    with_ = ", ".join(f"{k} as ({v})" for k, v in sources([source]).items())
    ORACLE[name] = f"with {with_ + ', ' if with_ else ''}prepared as ({duck_sql(prepare).replace('{x}', source)}) {rules_sql('prepared', rules, keys, areas)}"


SECTION = ["doc_id", "pos"]
add("sections_from_documents", SqlOperator("sections", "select * from {sections}"))
add_rules("text_rules", packs.TEXT_RULES, "refs", ["doc_id", "ref_pos"], prepare="select doc_id, ref_pos, raw_text as text from {x}")
add_rules("text_rules_by_area", packs.TEXT_RULES, "refs", ["doc_id", "ref_pos"], ("reference", "typo"), "select doc_id, ref_pos, replace(raw_text, '[J]. ', 'J]. ') as text from {x}")
add_rules("keyword_needles", [*packs.needles("TYPO-001", 3, ["the the", "en en", "de de", " ,"], "typo"), *packs.needles("STYLE-001", 2, ["stupid", "All rights", "@"], "logic")], "sections", SECTION)
add_rules("table_field_rules", packs.FIELD_RULES, "field_pairs", ["doc_id", "section_id", "table_index", "row_index", "col", "bare", "value"])
add_rules("formatting_rules", packs.FORMATTING_RULES, "sections", SECTION)
add_rules("strict_heading_rules", packs.STRICT_HEADING_RULES, "sections", SECTION)
add_rules("layout_rules", packs.LAYOUT_RULES, "sections", SECTION)
add_rules("list_rules", packs.LIST_RULES, "indented", SECTION, prepare=packs.LIST_LEVEL)
add_rules("formula_table_list_rules", packs.LAYOUT_FLAG_RULES, "flagged", SECTION)
add_rules("margin_rules", packs.MARGIN_RULES, "docs", ["doc_id"])
add_rules("doctype_rules", packs.DOC_TYPE_RULES, "docs", ["doc_id", "doc_type"], prepare=f"select *, {packs.DOC_TYPE} as doc_type from {{x}}")
add_rules("heading_format_rules", packs.INTEGRITY_RULES[:3], "sections", SECTION)
add_rules("paragraph_rules", packs.INTEGRITY_RULES[3:], "sections", SECTION)
for kind in ("journal", "monograph", "thesis", "conference"):
    add_rules(f"ref_rules_{kind}", packs.REFERENCE_RULES, "parts_of_refs", ["doc_id", "ref_pos"], (kind,))
add_rules("ref_rules_lines", packs.REFERENCE_LINE_RULES, "ref_facts", ["doc_id", "ref_pos"])
add("heading_jump", sequences.heading_jumps)
add("heading_reverse", sequences.heading_reversals)
add("heading_hier_strict", sequences.heading_hierarchy)
add("chapter_ordinal", sequences.chapter_ordinals)
add("figure_numbering", sequences.figure_numbering)
add("caption_sequence", sequences.caption_sequence)
add("caption_missing", sequences.missing_captions, sections="tabled")
add("blank_runs", sequences.blank_runs)
add("empty_line_first", sequences.first_empty_lines)
add("heading_body_spacing", sequences.heading_spacing, sections="spaced")
add("page_assignment", sequences.page_assignment, sections="paged")
add("size_carry_forward", sequences.carried_sizes, sections="paged")
add("doc_structure", structure.structure("licensed|license", "all rights", "[0-9]{5}"))
add("doc_presence", structure.presence)
add("empty_docs", structure.empty_documents)
add("duplicate_sections", structure.duplicate_sections, sections="repeated_ids")
add("ack_missing", structure.missing_acknowledgement)
add("doc_metadata", structure.document_metadata, sections="mathy")
add("ref_detect_fallback", structure.detected_references, lines="ref_lines", refs="no_refs")
add("abbreviations", structure.unexpanded_abbreviations, lines="mentions")
add("abstract_overlap", structure.abstract_overlap)
add("section_filter", structure.kept_sections)
add("section_exclusion", structure.unreviewed_sections, issues="known_issues")
add("citation_groups", citations.citation_groups)
add("citation_edges", citations.citation_edges)
add("missing_ref_entries", citations.missing_entries)
add("unused_ref_entries", citations.unused_entries)
add("citation_order", citations.citation_order)
add("severity_norm", issues.normalised)
add("issue_dedupe_exact", issues.distinct_issues)
add("issue_merge", issues.merged_reviews)
add("hybrid_merge", issues.hybrid_merge)
add("issue_sections", issues.attached_issues, issues="second")
add("page_top_issues", issues.page_top_issues)
add("score_impact", report.score_impact)
add("audit_summary", report.audit_summary)
add("review_summary", report.review_summary, chunks="chunk_rows")
add("rule_histogram", report.rule_histogram)
add("detection_rate", report.detection_rate, issues="error_issues")
add("task_listing", report.task_listing)
add("task_latest", report.task_latest)
add("retention_plan", report.retention_plan)
add("chunks", chunks.overlapping_chunks())
add("chunks_small", chunks.overlapping_chunks(80, 10))
add("field_summary", chunks.field_summary, fields="field_pairs")
add("hashed_embedding", retrieval.hashed_embedding)
add("token_jaccard", retrieval.token_jaccard, pairs="text_pairs")
add("prefix_similarity", retrieval.prefix_similarity, pairs="text_pairs")
add("paper_topk", retrieval.paper_topk_all_pairs, queries="line_queries")
QUERIES["paper_topk"] = lambda spark, sf_dir: retrieval.paper_topk(frame(spark, sf_dir, "line_queries"), frame(spark, sf_dir, "papers"))
add("verify_references", retrieval.verified, queries="line_queries")


def verify_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, papers = frame(spark, sf_dir, "line_queries"), frame(spark, sf_dir, "papers")
    queries = queries.drop("years")  # those of the text
    return retrieval.verify(queries, retrieval.paper_topk(queries, papers), papers)


QUERIES["verify_references"] = verify_references
DERIVED |= {
    "titled": (["sections"], "select doc_id, pos, case when doc_id % 2 = 0 then 'paragraph' else type end as type, case when pos = 2 then '参考文献：' when doc_id % 2 = 0 and pos = 6 then '致谢' when pos = 3 then '[1] Smith J. 2001.' when doc_id % 3 = 1 and pos = 5 then 'Figures' else text end as text, case when doc_id % 6 = 5 and pos = 4 then 'Heading 1' end as style, case when doc_id % 4 < 2 then 14.0e0 else 12.0e0 end as size_pt, doc_id % 8 = 2 as bold from {sections}"),
    "block_titles": ([], "select '参考文献' as title"),
    "jumbled": (["sections"], "select doc_id, pos, cast((pos * 7 + doc_id) % 10 as int) as section_id from {sections}"),
    "gapped_refs": (["refs"], "select doc_id, ref_pos, case when doc_id % 7 = 1 and ref_pos = 3 then '[abc]' when doc_id % 3 = 0 and ref_pos > 2 then concat('[', cast(ref_pos + 1 as string), ']') else ref_id end as ref_id from {refs}"),
    "listed_lines": (["sections"], "select doc_id, pos as ref_pos, concat(substring(text, 1, 60), ' ') as raw_text from {sections}"),
    "page_texts": (["sections"], "select doc_id, cast(floor(pos / 3) as int) + 1 as page, text from {sections} where pos % 5 <> 2 union all select doc_id, cast(floor((pos + doc_id % 4) / 3) as int) + 2, text from {sections} where (pos + doc_id) % 4 = 1"),
    "paged_sections": (["sections"], "select doc_id, pos, text, case when pos % 2 = 0 then cast(floor(pos / 4) as int) + 1 end as page from {sections}"),
    "places": (["sections"], "select doc_id, pos, cast(floor(pos / 3) as int) + 1 as page from {sections}"),
    "verdicts": (["sections"], "select doc_id, pos * 3 as pos, case pos % 3 when 0 then 'verified' when 1 then 'needs_review' else 'unverified' end as verdict from {sections}"),
}
add("section_id_order", sequences.section_id_order, sections="jumbled")
add("ref_block_extract", structure.reference_block, sections="titled", titles="block_titles")
add("annotation_join", placement.page_notes)


def _with(names: list[str], sql: str) -> str:
    return "with recursive " + ", ".join(f"{k} as ({v})" for k, v in sources(names).items()) + ", " + sql


def issue_dedupe_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.near_distinct_issues(frame(spark, sf_dir, "labelled"), ["doc_id"])


QUERIES["issue_dedupe_fuzzy"] = issue_dedupe_fuzzy
ORACLE["issue_dedupe_fuzzy"] = _with(
    ["labelled"],
    """o as (select *, row_number() over (partition by doc_id, issue_type, label order by "at") n from labelled),
f as (select doc_id, issue_type, label, n, "at", start_char, end_char, true keep, [struct_pack(s := start_char, e := end_char)] kept from o where n = 1
  union all select o.doc_id, o.issue_type, o.label, o.n, o."at", o.start_char, o.end_char, not d.near, case when d.near then kept else list_append(kept, struct_pack(s := o.start_char, e := o.end_char)) end
  from f join o on o.doc_id = f.doc_id and o.issue_type = f.issue_type and o.label = f.label and o.n = f.n + 1,
  lateral (select len(list_filter(kept, lambda y: y.s is null or o.start_char is null or (abs(y.s - o.start_char) <= 3 and abs(y.e - o.end_char) <= 3))) > 0 near) d)
select doc_id, issue_type, label, "at", start_char, end_char from f where keep""",
)


def span_relocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.relocated_spans(frame(spark, sf_dir, "spans")).select("doc_id", "pos", "start_char", "new_start", "new_end")


DERIVED["spans"] = (["sections"], "select doc_id, pos, text, substring(text, cast(1 + pos % 5 as int), 4) as original, case when pos % 3 > 0 then cast(pos * 7 % 30 as int) end as start_char, case when pos % 3 > 0 then cast(pos * 7 % 30 + 4 as int) end as end_char from {sections}")
QUERIES["span_relocate"] = span_relocate
ORACLE["span_relocate"] = _with(
    ["spans"],
    """c as (select *, case when start_char is not null and substring(text, start_char + 1, end_char - start_char) = original then start_char when length(original) > 0 then
  (list_sort(list_transform(list_filter(range(0, greatest(length(text), 1)), lambda i: substring(text, cast(i as int) + 1, length(original)) = original), lambda i: [abs(i - coalesce(start_char, 0)), i])))[1][2] end n from spans)
select doc_id, pos, start_char, cast(n as int) new_start, cast(n + length(original) as int) new_end from c""",
)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 50, against all."""
    vectors = frame(spark, sf_dir, "embeddings")
    return vector_index.vector_topk(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES["vector_topk"] = vector_topk
ORACLE["vector_topk"] = """with s as (select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) score from embeddings q, embeddings v where q.vec_id % 50 = 0 and q.vec_id <> v.vec_id)
select query_id, vec_id, cast(k as int) k, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) k from s) r where k <= 3"""


def paper_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three papers whose hashed embeddings are nearest to those of each benchmark text and its beginning."""
    papers = retrieval.candidate_texts(frame(spark, sf_dir, "papers")).select(F.col("paper_id").alias("id"), "text")
    asked = frame(spark, sf_dir, "asked_texts")
    return vector_index.vector_topk(retrieval.hashed_vectors(papers), retrieval.hashed_vectors(asked), itself=True)


DERIVED |= {
    "asked_texts": (["benchmark"], "select item_id as id, text from {benchmark} union all select item_id + 1000000, substring(text, 1, 80) from {benchmark}"),
    "paper_texts": (["papers"], retrieval.candidate_texts.sql.replace("select paper_id, year,", "select paper_id as id,")),
}
QUERIES["paper_vectors"] = paper_vectors
ORACLE["paper_vectors"] = _with(
    ["asked_texts", "paper_texts"],
    r"""t as (select 0 side, id, text from asked_texts union all select 1, id, text from paper_texts), w as (select side, id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) w from t),
c as (select side, id, ('0x' || substr(sha256(w), 1, 8))::bigint % 64 d, count(*) n from w group by 1, 2, 3), v as (select side, id, d, round(n / sqrt(sum(n * n) over (partition by side, id)), 9) x from c),
l as (select side, id, sqrt(sum(x * x)) l from v group by 1, 2), p as (select q.id a, b.id b, sum(q.x * b.x) s from v q join v b on q.side = 0 and b.side = 1 and q.d = b.d group by 1, 2),
r as (select qi.id query_id, bi.id vec_id, round(coalesce(s, 0) / (qi.l * bi.l), 6) score from (from l where side = 0) qi cross join (from l where side = 1) bi left join p on a = qi.id and b = bi.id)
select query_id, vec_id, cast(k as int) k, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) k from r) z where k <= 3""",
)


def audit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.reports(frame(spark, sf_dir, "issues"))


QUERIES["audit_reports"] = audit_reports


def audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packs over sections and references of the same ids: issues and score of each document."""
    return scores(audit({"sections": frame(spark, sf_dir, "sections"), "refs": frame(spark, sf_dir, "odd_refs")}))


def _audit_sql() -> str:
    rows = " union all ".join(
        [
            rules_sql("sections", packs.FORMATTING_RULES, ["doc_id", "pos"]),
            rules_sql("sections", packs.INTEGRITY_RULES, ["doc_id", "pos"]),
            rules_sql("parts_of_refs", packs.REFERENCE_RULES, ["doc_id", "ref_pos"]),
            f"select doc_id, pos, rule_id, 4 from ({sequences.heading_jumps.oracle({}, ['sections'])}) a",
            f"select doc_id, pos, rule_id, 3 from ({sequences.figure_numbering.oracle({}, ['sections'])}) b",
        ]
    )
    points = "case severity when 5 then 10 when 4 then 5 when 3 then 2 when 2 then 1 else 0 end"
    return _with(["sections", "parts_of_refs"], f"i as ({rows}) select doc_id, count(*) issues, cast(sum({points}) as bigint) score, cast(sum(case when severity >= 4 then 1 else 0 end) as bigint) high from i group by doc_id")


QUERIES["audit_scores"], ORACLE["audit_scores"] = audit_scores, _audit_sql()


def stage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed aggregation of the task stream, here over the whole table at once."""
    return stage_counts(frame(spark, sf_dir, "tasks"), "1 day")


QUERIES["stage_windows"] = stage_windows
ORACLE["stage_windows"] = _with(["tasks"], "d as (select date_trunc('day', updated_at) s, current_stage, progress from tasks) select s \"start\", current_stage, count(*) n, round(avg(progress), 6) mean from d group by 1, 2")


#: Event types that stand for the end of a task in the given events.
_ENDS = ("purchase", "error")


def latest_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_status(frame(spark, sf_dir, "tasks"), _ENDS)


def task_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks' updates as a stream through keyed state, and what it has written of each task at the end. All files are one batch, so that none is late."""
    scratch = Tables(spark, "status")
    table = scratch.write(frame(spark, sf_dir, "tasks"), "tasks")
    tasks = spark.readStream.schema(table.schema).parquet(f"{scratch.path}/tasks")
    status.write_task_status(tasks, f"{scratch.path}/out", f"{scratch.path}/checkpoint", final=_ENDS).awaitTermination()
    return status.status_table(spark, f"{scratch.path}/out")


QUERIES["latest_tasks"], QUERIES["task_status_stream"] = latest_tasks, task_status_stream
_ENDED = """r as (select *, current_stage in ('purchase', 'error') ended from tasks), f as (select *, row_number() over (partition by id order by ended desc, case when ended then updated_at end, case when ended then event_id end, updated_at desc, event_id desc) k from r)
select id, updated_at, current_stage, progress{} from f where k = 1"""
ORACLE["latest_tasks"] = _with(["tasks"], _ENDED.format(""))
ORACLE["task_status_stream"] = _with(["tasks"], _ENDED.format(", ended final"))


# Operators as DataFrame code, each with SQL that is written from its definition and not from the code.
DERIVED |= {
    "marked": (
        ["sections"],
        """select doc_id, pos, case pos % 6 when 0 then concat(text, ' 使用卷积神经网络（CNN）与GPU，', 'LSTM') when 1 then concat('import x;', code(10), '  f(', text, ')') when 2 then concat('[3] ', text) when 3 then concat('GPU（图形处理器）和 BERT ', substring(text, 1, 20))
  when 4 then concat(substring(text, 1, 30), ' pOx APIs', code(10), code(10), '# 注释', case when pos % 4 = 0 then '' else concat(code(10), 'f(x) # 中文') end) else concat('NASA x ', substring(text, 1, 10)) end as text, case pos % 7 when 0 then 'Courier New' when 1 then 'SimSun' end as font from {sections}""",
    ),
    "needles": (["sections"], "select doc_id, pos, case when pos % 5 = 4 then '' else text end as text, case pos % 4 when 0 then substring(text, 3, 5) when 1 then 'not in it at all' when 2 then '' end as needle from {sections}"),
    "footers": (["docs"], """select doc_id, 0 as section, case doc_id % 4 when 0 then '<w:jc w:val="center"/><w:instrText>page</w:instrText>' when 1 then '<w:jc w:val="left"/> PAGE' when 2 then concat('<w:jc w:val=', code(39), 'center', code(39), '/>') end as footer from {docs}"""),
    "seen_chunks": (["chunk_rows"], "select doc_id, cast((pos * 7 + doc_id) % 5 as int) as section_id, pos, k from {chunk_rows}"),
    "task_times": (["tasks"], "select id, event_id, case event_id % 3 when 0 then '2024-03-01T23:30:00' when 1 then '2024-03-01T10:00:05+02:00' else '2024-02-29 00:00:00Z' end as written from {tasks}"),
    "reviews": (
        ["issues"],
        """select doc_id, cast(floor(pos / 4) as int) as section_id, pos as chunk, (pos + k) % 2 as source, pos * 3 + k as at, case when k = 2 and pos % 2 = 0 then 'format' else 'logic' end as issue_type,
  case when doc_id % 2 = 0 or original = '' then 'none' else original end as label, start_char + 2 * k as start_char, end_char + 2 * k as end_char from {issues}""",
    ),
    "coded": (
        ["tabled"],
        """select doc_id, pos, section_id, type, level, size_pt, line_spacing, first_line_indent, row_count, page_start, page_end, cast((doc_id + pos) % 5 as double) / 4 as left_indent, case when pos % 3 = 0 then 'List Bullet 2' end as style,
  case when pos % 13 = 4 then 'Courier New' else font end as font, case when pos % 7 = 2 then concat('import x;', code(10), '  f(', text, ')') when pos % 11 = 3 then '# note' when pos % 10 = 6 then concat('续表 1 ', text) when pos % 10 = 1 then concat('表 1 ', text) else text end as text from {tabled}""",
    ),
    "issue_views": (["issues"], "select doc_id, section_id as chunk, case when doc_id % 3 = 0 then case k when 0 then 'issues' when 1 then 'local_issues' else 'llm_issues' end when k = 0 then 'local_issues' when k = 1 then 'llm_issues' else 'table_issues' end as view, pos * 3 + k as seq, issue_type, case when pos % 2 = 0 then 'same' else rule_id end as rule_id from {issues}"),
}
_CHINESE = "regexp_matches({}, '[一-鿿]')"


def _codey(c: str) -> str:
    """Whether a line begins like code or has a word or call of it, by the patterns of lines.py."""
    return "(" + " or ".join(f"regexp_matches({c}, '{p}')" for p in (lines.CODE_LINE, lines.CODE_WORD, lines.CODE_CALL)) + ")"


_IS_CODE = f"(regexp_matches(line, '{lines.CODE_LINE}') or (not regexp_matches(line, '{lines.CHINESE}') and (contains(line, '#') or contains(line, ';') or {_codey('line')})))"
_LINES_SQL = r"ls as (select doc_id, pos, n, line from (select doc_id, pos, unnest(list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')), lambda x: x <> '')) line, generate_subscripts(list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')), lambda x: x <> ''), 1) - 1 n from marked) a)"
_FLAG_SQL = rf"""o as (select *, line whole, case when regexp_matches(line, '^(///|#)') then '' else line end bare from ls),
q as (select *, rtrim(split_part(whole, '///', 1)) b1, rtrim(split_part(whole, '#', 1)) b2 from o), r as (select doc_id, pos, n, whole, case when bare = '' then '' when strpos(whole, '///') > 1 and {_codey('b1')} then b1 when strpos(whole, '#') > 1 and {_codey('b2')} then b2 else whole end line from q),
c as (select doc_id, pos, count(*) n, sum(case when line = '' or {_IS_CODE} then 1 else 0 end) k, bool_or(line = '') comment, bool_or({_CHINESE.format('line')}) cjk from r group by 1, 2)
select m.doc_id, m.pos, regexp_matches(lower(coalesce(font, '')), 'consolas|courier|monaco|fira code|lucida console') or coalesce(contains(text, '```') or (k >= 2 and k >= 0.6 * n) or (n = 1 and (comment or (k = 1 and not cjk))), false) is_code from marked m left join c on c.doc_id = m.doc_id and c.pos = m.pos"""
# Words may have letters and digits of any script; RE2's \b knows those of ASCII only, and would find `doi` in `ñdoi`.
_NO_WORD, _IN_WORD = r"[^\p{L}\p{N}_]", r"[\p{L}\p{N}_]"
_KEPT_SQL = rf"kept as (select * from ls where not ({_IS_CODE} or regexp_matches(line, '^(\[[0-9]+\]|参考文献($|{_NO_WORD})|[0-9]+\.|\[[A-Z]\])') or regexp_matches(line, '(?i)\[[jmdcp]\]|(^|{_NO_WORD})(doi($|{_NO_WORD})|[0-9]{{4}}($|{_NO_WORD})|et al\.{_IN_WORD})')))"
def _strict_reader(chunks: list[dict]) -> list[list[dict]]:
    """A reviewer for outside_review: it fails at texts that name a licence, answers every fifth section wrongly and has one remark on others."""
    if any("license" in c["text"].lower() for c in chunks):
        raise RuntimeError("no answer")
    remark = lambda c: {"rule_id": "READ-001", "issue_type": "style", "severity": 1 + c["pos"] % 7, "message": "read again", "original": c["text"][2:7], "start_char": 0, "end_char": 2}
    return [[{"severity": "none"}] if c["pos"] % 5 == 2 else [remark(c)] if len(c["text"]) >= 7 else [] for c in chunks]


def _grid(cells: DataFrame) -> DataFrame:
    """Table rows of the cells' documents: names and values in order of columns, of even documents twice, as two tables."""
    pair = F.struct("col", F.array("name", F.when(F.col("value") != "x", F.col("value"))).alias("p"))
    rows = cells.groupBy("doc_id", F.col("section_id").alias("pos"), "row_index").agg(F.flatten(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x.p)).alias("cells"))
    return rows.unionByName(rows.where("doc_id % 2 = 0").withColumn("pos", F.col("pos") + 4))


MADE["grid"] = (["cells"], _grid)
DERIVED |= {
    "grid": (
        ["cells"],
        "with r as (select doc_id, section_id as pos, row_index, flatten(list([name, case when value <> 'x' then value end] order by col)) as cells from {cells} group by 1, 2, 3) select * from r union all select doc_id, pos + 4, row_index, cells from r where doc_id % 2 = 0",
    ),
    "coded_groups": (["marked"], "select doc_id, pos, cast(floor(pos / 2) as int) as section_id, text, font from {marked}"),
}
DERIVED |= {
    "dated": (["cells"], "select doc_id, row_index, col, case when value like '2024%' then concat(cast(1990 + doc_id % 40 as string), '年', cast(1 + doc_id % 14 as string), '月', cast(1 + doc_id % 33 as string), '日') when value = 'x' then '2024年1月' else value end as value from {cells}"),
    "half_points": (["orders"], "select o_orderkey as id, case o_orderkey % 7 when 0 then 'x' when 1 then '' when 2 then concat(cast(o_orderkey % 50 as string), '.5') when 3 then null else cast(o_orderkey % 97 as string) end as half from {orders}"),
}
DERIVED["spoken"] = (
    ["sections"],
    """select doc_id, pos, case (doc_id * 5 + pos) % 12 when 0 then concat('abstract:x', code(10), text, code(10), ' Abstract:y') when 1 then concat(text, code(10), 'Keywords:a;b; c', code(10), 'Keywords: a;b') when 2 then concat(text, '的的，，。。的的')
  when 3 then concat('Basically ', text, '听说很开心') when 4 then concat('[1] ', text, ' D]. and [[J]. 2001', code(10), 'x C]. y') when 5 then concat('参考文献 [2] none ', substring(text, 1, 5)) when 6 then concat('abc，', text, ' Fig. 2')
  when 7 then concat('ISBN abc，', text, ' basically so') when 8 then '' when 9 then null else text end as text from {sections}""",
)


def _findings_sql() -> str:
    """Needles and line patterns as values, for the oracle; text patterns one by one."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    head = lambda e: f"{quote(e.rule_id)} rule_id, {quote(e.issue_type)} issue_type, {e.severity} severity, {quote(e.message)} message, {quote(e.suggestion)} suggestion"
    bare = r"(^|[^\[])[A-Z]\]\."
    line = {"FORMAT-004": r"(?i)^Abstract:\S", "FORMAT-006": r"(?i)^Keywords:\S", "FORMAT-005": r"(?i)^Keywords:.*;\S", "REF-002": bare, "REF-003": r"\[\[[A-Z]\]\."}
    text = {
        "FORMAT-001": rf"regexp_matches(text, '[A-Za-z][，。；：、]') and not regexp_matches(text, '{'|'.join(packs.LABEL_HINTS)}')", "FORMAT-002": r"regexp_matches(text, 'Fig\.|Table|Eq\.')",
        "REF-001": r"regexp_matches(text, '\[[0-9]+\]\s*[^\n]|\b[0-9]{4}\b') and contains(text, '参考文献') and not regexp_matches(text, '\[[0-9]+\][^\n]+[0-9]{4}')",
        "REF-004": rf"regexp_matches(text, '\[[0-9]+\][^\n]*[A-Za-z][^\n]*[0-9]{{4}}') and (regexp_matches(text, '{bare}') or regexp_matches(text, '\[\[[A-Z]\]\.'))",
    }
    found = []
    for e in findings.CATALOGUE:
        if e.how == "line":
            found.append(f"select doc_id, pos, {head(e)}, l original, p - 1 start_char, p - 1 + length(l) end_char from (select *, instr(text, l) p from lines_) z where regexp_matches(l, '{line[e.rule_id]}')")
        elif e.how == "text":
            found.append(f"select doc_id, pos, {head(e)}, null, null, null from spoken where {text[e.rule_id]}")
        else:
            place = f"instr(text, {quote(e.what)})"
            found.append(f"select doc_id, pos, {head(e)}, {quote(e.what)}, case when {place} > 0 then {place} - 1 else 0 end, case when {place} > 0 then {place} - 1 + {len(e.what)} else least(length(text), {len(e.what)}) end from spoken where contains({'lower(text)' if e.how == 'word' else 'text'}, {quote(e.what)})")
    lines_ = "lines_ as (select doc_id, pos, text, trim(x) l from (select *, unnest(string_split(text, chr(10))) x from spoken where text is not null) y where trim(x) <> '')"
    return f"{lines_}, i(doc_id, pos, rule_id, issue_type, severity, message, suggestion, original, start_char, end_char) as ({' union all '.join(found)}) select doc_id, pos, rule_id, issue_type, severity, message, suggestion, original, cast(start_char as int) start_char, cast(end_char as int) end_char from i"


#: Numbers of entries by their ids, and distinct listed (by their text first) and cited numbers, for the oracle.
_OWN = "own as (select doc_id, ref_pos, coalesce(try_cast(case when regexp_matches(replace(replace(ref_id, '[', ''), ']', ''), '^[+-]?[0-9]{1,10}$') then replace(replace(ref_id, '[', ''), ']', '') end as int), 0) number from listed_refs)"
_SIDES = _OWN + ", l as (select distinct doc_id, number from (select o.doc_id, coalesce(try_cast(nullif(regexp_extract(raw_text, '^\\s*\\[([0-9]{1,10})\\]', 1), '') as int), number) number from own o join listed_refs r using (doc_id, ref_pos)) z where number > 0), c as (select distinct doc_id, number from edges where number > 0)"
_ADDED = {
    "ref_parts": (citations.with_parts, ["odd_refs"], "x as (" + DERIVED["parts_of_refs"][1].replace("{odd_refs}", "odd_refs") + ") select * from x"),
    "missing_refs": (citations.missing_references, ["edges", "listed_refs"], f"{_SIDES}, m as (select * from c where (doc_id, number) not in (from l)) select doc_id, 'REF-CONSIST-001' rule_id, string_agg(number::varchar, ',' order by number) numbers from m where doc_id in (select doc_id from l) group by 1"),
    "unused_refs": (citations.unused_references, ["edges", "listed_refs"], f"{_SIDES}, m as (select * from l where (doc_id, number) not in (from c)) select doc_id, 'REF-CONSIST-002' rule_id, string_agg(number::varchar, ',' order by number) numbers from m where doc_id in (select doc_id from c) group by 1"),
    "bidirectional_refs": (citations.bidirectional_references, ["edges", "listed_refs"], f"{_SIDES} (select doc_id, number, 'REF_MISSING_001' rule_id from (from c except from l) a) union all (select doc_id, number, 'REF_UNUSED_001' from (from l except from c) b)"),
    "ref_list_order": (citations.reference_order, ["edges", "listed_refs"], f"""{_OWN}, l as (select doc_id, number, min(ref_pos) p from own where number > 0 group by 1, 2), s as (select doc_id, number, min(pos) p from edges group by 1, 2),
r as (select doc_id, number, s.p seen, l.p place from l join s using (doc_id, number)),
o as (select *, (select count(*) from r b where b.doc_id = a.doc_id and (b.seen, b.number) < (a.seen, a.number)) x, (select count(*) from r b where b.doc_id = a.doc_id and b.place < a.place) y from r a)
select doc_id, count(*) out_of_place, 'REF_ORDER_001' rule_id from o where x <> y group by 1"""),
    "ref_numbering_gap": (citations.reference_numbering, ["gapped_refs"], f"""{_OWN.replace("listed_refs", "gapped_refs")}, w as (select * from own where number <> ref_pos) select doc_id, ref_pos, number, 'REF_ORDER_002' rule_id from w where not exists (from w b where b.doc_id = w.doc_id and b.ref_pos < w.ref_pos)"""),
    "chart_mentions": (
        structure.unmentioned_charts,
        ["charts", "paragraphs"],
        """n as (select *, nullif(caption_number, '') num from charts) select doc_id, pos, caption_number, 'ERR_INT_CHART_REF_001' rule_id from n where not exists (from paragraphs p where p.doc_id = n.doc_id
  and case when num is null then regexp_matches(lower(text), '图|表|figure|table') else contains(text, '图' || num) or contains(text, '表' || num) or regexp_matches(lower(text), '(figure|table) ?' || num) end)""",
    ),
    "ref_section_locate": (
        placement.reference_sections,
        ["listed_lines", "sections"],
        r"""c as (select doc_id, pos, section_id, lower(regexp_replace(text, '\s+', '', 'g')) t from sections), r as (select doc_id, ref_pos, lower(regexp_replace(raw_text, '\s+', '', 'g')) t from listed_lines),
h as (select r.doc_id, ref_pos, min(pos) pos from r join c on c.doc_id = r.doc_id and c.t <> '' and r.t <> '' and (instr(c.t, left(r.t, 120)) > 0 or instr(r.t, c.t) > 0) group by 1, 2)
select h.doc_id, ref_pos, section_id from h join c using (doc_id, pos)""",
    ),
    "section_page_map": (
        placement.section_pages,
        ["paged_sections", "page_texts"],
        r"""c as (select doc_id, pos, page, lower(regexp_replace(text, '\s+', '', 'g')) t, row_number() over (partition by doc_id order by pos) n from paged_sections),
g as (select doc_id, page, string_agg(lower(regexp_replace(text, '\s+', '', 'g')), ' ') t from page_texts group by 1, 2),
h as (select c.doc_id, c.n, list(g.page order by g.page) pages from c join g on g.doc_id = c.doc_id and c.t <> '' and contains(g.t, c.t) group by 1, 2),
m as (select c.*, pages from c left join h using (doc_id, n)),
w as (select doc_id, n, pos, page, pages[1] found, pages[1] last_ from m where n = 1
  union all select m.doc_id, m.n, m.pos, m.page, x.f, coalesce(x.f, last_) from w join m on m.doc_id = w.doc_id and m.n = w.n + 1, lateral (select coalesce(list_min(list_filter(m.pages, lambda p: last_ is null or p >= last_)), m.pages[1]) f) x)
select doc_id, pos, cast(coalesce(found, page, 1) as int) page, found is not null matched from w""",
    ),
    "latency_stats": (
        lambda df: report.latency_stats(df, "current_stage", "progress", F.col("progress") > 10, "updated_at", "event_id"),
        ["tasks"],
        """r as (select *, row_number() over (partition by current_stage order by progress) k, count(progress) over (partition by current_stage) n from tasks where progress is not null),
p as (select current_stage, max(case when k = greatest(1, ceil(0.5 * n)) then progress end) p50, max(case when k = greatest(1, ceil(0.9 * n)) then progress end) p90, max(case when k = greatest(1, ceil(0.99 * n)) then progress end) p99 from r group by 1)
select t.current_stage, count(*) tasks, count(*) filter (where progress > 10) succeeded, round(count(*) filter (where progress > 10) / count(*), 6) success_rate, round(avg(progress), 6) mean, min(progress) least, max(progress) most,
  round(count(*) / nullif(epoch(max(updated_at)) - epoch(min(updated_at)), 0), 6) throughput, any_value(p50) p50, any_value(p90) p90, any_value(p99) p99 from tasks t left join p on p.current_stage is not distinct from t.current_stage group by 1""",
    ),
    "code_like_docs": (chunks.code_like_documents, ["code_lines"], f"""c as (select doc_id, {_IS_CODE} code, contains(line, '```') fence from code_lines where trim(line) <> '')
select doc_id, count(*) filter (where code) code_lines, count(*) all_lines, bool_or(fence) or (count(*) filter (where code) >= 2 and count(*) filter (where code) >= 0.6 * count(*)) or bool_and(code) code_like from c group by 1"""),
    "table_row_chunks": (chunks.table_row_chunks, ["grid"], "g as (select * from grid) select doc_id, cast(dense_rank() over (partition by doc_id order by pos) as int) table_index, cast(row_index + 1 as int) row_index, array_to_string(list_transform(cells, lambda c: coalesce(c, '')), chr(9)) chunk, cast(len(cells) as int) cell_count from g"),
    "review_groups": (chunks.review_groups, ["coded_groups"], f"""{_LINES_SQL.replace("marked", "coded_groups")}, flag as (with {_FLAG_SQL.replace("marked", "coded_groups")}) select g.doc_id, g.section_id, count(*) chunks, count(*) filter (where is_code) code_chunks, bool_and(is_code) skipped from coded_groups g join flag f on f.doc_id = g.doc_id and f.pos = g.pos group by 1, 2"""),
    "required_sections": (
        lambda df: structure.required_parts(df, {"the": ["the"], "license": ["licensed"], "rights": ["all rights"], "page": ["seite", "página"]}),
        ["sections"],
        """w(part, word) as (values ('the', 'the'), ('license', 'licensed'), ('rights', 'all rights'), ('page', 'seite'), ('page', 'página')), d as (select distinct doc_id from sections), p as (select distinct part from w)
select doc_id, part, 'ERR_INT_REQ_001' rule_id from d, p where not exists (from sections s, w where s.doc_id = d.doc_id and w.part = p.part and contains(lower(s.text), w.word))""",
    ),
    "completed_tasks": (
        lambda df: report.tasks_older_than(df, 2, _ENDS, F.lit("2024-02-01 00:00:00")).select("id", "event_id", "current_stage", "size"),
        ["tasks"],
        "l as (select *, row_number() over (partition by id order by updated_at desc, event_id desc) k from tasks) select id, event_id, current_stage, cast(size as int) size from l where k = 1 and current_stage in ('purchase', 'error') and updated_at <= timestamp '2024-01-30 00:00:00'",
    ),
    "retained_tasks": (
        lambda df: report.retention(df, {"purchase": 2, "error": 1.5}, F.lit("2024-02-01 00:00:00"))[1].select("id", "event_id", "current_stage"),
        ["tasks"],
        "l as (select *, row_number() over (partition by id order by updated_at desc, event_id desc) k from tasks), g as (select id from l where k = 1 and ((current_stage = 'purchase' and updated_at <= timestamp '2024-01-30 00:00:00') or (current_stage = 'error' and updated_at <= timestamp '2024-01-30 12:00:00'))) select id, event_id, current_stage from tasks t where not exists (from g where g.id is not distinct from t.id)",
    ),
    "date_fixes": (lines.date_fixes, ["dated"], "d as (select * from dated where regexp_matches(value, '^[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日$')) select doc_id, row_index, cast(col as int) col, value, strftime(try_cast(regexp_replace(value, '^([0-9]+)年([0-9]+)月([0-9]+)日$', '\\1-\\2-\\3') as date), '%Y-%m-%d') fixed from d"),
    "half_point_sizes": (
        sizes_of,
        ["half_points"],
        "h as (select *, try_cast(half as double) / 2 p from half_points) select id, half, case when p = floor(p) then cast(p as bigint) || 'pt' else printf('%.1f', round_even(p, 1)) || 'pt' end size, case when p = floor(p) then p else round_even(p, 1) end size_pt from h",
    ),
    "outside_review": (
        lambda df: outside_issues(df, _strict_reader, 7),
        ["sections"],
        """w as (select *, substr(text, 3, 5) o from sections where length(text) >= 7 and not contains(lower(text), 'license') and pos % 5 <> 2) select doc_id, pos, 'READ-001' rule_id, 'style' issue_type, cast(least(5, 1 + pos % 7) as int) severity, 'read again' message, null::varchar suggestion, o original,
  cast(instr(text, o) - 1 as int) start_char, cast(instr(text, o) - 1 + 5 as int) end_char from w""",
    ),
    "text_findings": (lambda df: findings.text_issues(df, ["doc_id", "pos"]), ["spoken"], _findings_sql()),
    "code_sections": (lines.code_sections, ["marked"], f"{_LINES_SQL}, {_FLAG_SQL}"),
    "audit_lines": (lines.audit_lines, ["marked"], f"{_LINES_SQL}, {_KEPT_SQL} select doc_id, pos, cast(n as int) n, line from kept"),
    "undefined_abbreviations": (lambda df: lines.undefined_abbreviations(lines.audit_lines(df)), ["marked"], rf"""{_LINES_SQL}, {_KEPT_SQL}, z as (select doc_id from kept group by 1 having bool_or({_CHINESE.format('line')})),
u as (select distinct doc_id, upper(x) a from (select doc_id, unnest(regexp_extract_all(line, '\b(?:[A-Z]{{2,}}[A-Za-z0-9]*|[A-Z][a-z]+[A-Z][A-Za-z0-9]*)\b')) x from kept) t),
d as (select doc_id, upper(x) a from (select doc_id, unnest(regexp_extract_all(line, '[一-鿿][^（）()]{{1,40}}?\s*[（(]\s*([A-Z]{{2,}}[A-Za-z0-9]*)\s*[)）]', 1)) x from kept) t
  union all select doc_id, upper(regexp_extract(x, '^[A-Z0-9a-z]+')) from (select doc_id, unnest(regexp_extract_all(line, '[A-Z]{{2,}}[A-Za-z0-9]*\s*[（(]\s*[^（）()]{{2,40}}\s*[)）]')) x from kept) t where {_CHINESE.format('x')})
select doc_id, a abbreviation, 'CONSIST-003' rule_id, 1 severity from u where doc_id in (from z) and length(a) >= 2 and not exists (from d where d.doc_id = u.doc_id and d.a = u.a)"""),
    "needle_positions": (lines.needle_positions, ["needles"], "x as (select *, strpos(text, needle) p from needles) select doc_id, pos, cast(case when coalesce(text, '') = '' or coalesce(needle, '') = '' or p = 0 then 0 else p - 1 end as int) start_char, cast(case when coalesce(text, '') = '' or coalesce(needle, '') = '' then 0 when p = 0 then least(length(text), length(needle)) else p - 1 + length(needle) end as int) end_char from x"),
    "footer_rules": (lines.footer_issues, ["footers"], """x as (select * from footers) select doc_id, section, 'PAGE-001' rule_id, 2 severity from x where footer is null or not footer ilike '%page%'
  or not (contains(footer, 'w:jc w:val="center"') or contains(footer, 'w:jc w:val=' || chr(39) || 'center' || chr(39)))"""),
    "section_chunks": (lines.section_groups, ["seen_chunks"], "g as (select doc_id, section_id, min(pos * 1000000 + k) f, count(*) chunks, string_agg(pos || '.' || k, ',' order by pos, k) members from seen_chunks group by 1, 2) select doc_id, section_id, cast(row_number() over (partition by doc_id order by f, section_id) as int) place, chunks, members from g"),
    "task_times_utc8": (lambda df: df.select("id", "event_id", lines.utc8(df.written).alias("rendered")), ["task_times"], "x as (select * from task_times) select id, event_id, case event_id % 3 when 0 then '2024-03-02 07:30:00+08:00' when 1 then '2024-03-01 16:00:05+08:00' else '2024-02-29 08:00:00+08:00' end rendered from x"),
    "sentinel_counts": (lambda df: lines.sentinel_counts(df.selectExpr("doc_id", "pos", "named_struct('font', coalesce(font, 'unknown'), 'runs', array(named_struct('size', case when pos % 3 = 0 then 'unknown' else '12' end), named_struct('size', text))) as s"), "doc_id"), ["sections"], "x as (select * from sections) select doc_id, cast(sum(case when font is null then 1 else 0 end + case when pos % 3 = 0 then 1 else 0 end + case when text = 'unknown' then 1 else 0 end) as bigint) n from x group by 1"),
    "report_counts": (lambda d, i, v, c: report.report_counts(d, i, v, c), ["sections", "first", "verdicts", "known_issues"], "x as (select distinct doc_id from sections) select doc_id, a chunk_issues, b unverified, c consistency, a + b + c issues_count from (select doc_id, (select count(*) from first i where i.doc_id = x.doc_id) a, (select count(*) from verdicts i where i.doc_id = x.doc_id and verdict in ('needs_review', 'unverified')) b, (select count(*) from known_issues i where i.doc_id = x.doc_id) c from x) y"),
    "report_compaction": (lambda df: report.compact_views(df, ["issue_type", "rule_id"]), ["issue_views"], """e as (select doc_id, chunk, view, issue_type || '|' || rule_id entry, min(seq) seq from issue_views group by 1, 2, 3, 4),
h as (select distinct doc_id, chunk from issue_views where view = 'issues'),
m as (select doc_id, chunk, entry, min(case view when 'local_issues' then 1 when 'llm_issues' then 2 else 3 end * 1000000000::bigint + seq) seq from e where view <> 'issues' and not exists (from h where h.doc_id = e.doc_id and h.chunk = e.chunk) group by 1, 2, 3),
a as (select doc_id, chunk, view, count(*) n, string_agg(entry, ';' order by seq) entries from (select doc_id, chunk, view, entry, seq from e union all select doc_id, chunk, 'issues', entry, seq from m) u group by 1, 2, 3)
select a.* from a where view = 'issues' or not exists (from a b where b.doc_id = a.doc_id and b.chunk = a.chunk and b.view = 'issues' and b.entries = a.entries)"""),
}


def _near(source: str, out: str, scope: str, order: str) -> str:
    """Issues without near copies, one issue after the other, for the oracle."""
    columns = "doc_id, section_id, chunk, source, at, issue_type, label, start_char, end_char"
    same = " and ".join(f"o.{c} = f.{c}" for c in [*scope.split(", "), "issue_type", "label"])
    return f"""{out}_o as (select *, row_number() over (partition by {scope}, issue_type, label order by {order.replace("at", '"at"')}) n from {source}),
{out}_f as (select {columns}, n, true keep, [struct_pack(s := start_char, e := end_char)] kept from {out}_o where n = 1
  union all select {', '.join('o.' + c for c in columns.split(', '))}, o.n, not d.near, case when d.near then kept else list_append(kept, struct_pack(s := o.start_char, e := o.end_char)) end
  from {out}_f f join {out}_o o on {same} and o.n = f.n + 1,
  lateral (select len(list_filter(kept, lambda y: y.s is null or o.start_char is null or (abs(y.s - o.start_char) <= 3 and abs(y.e - o.end_char) <= 3))) > 0 near) d),
{out} as (select {columns} from {out}_f where keep)""".replace(", at,", ', "at",').replace("o.at,", 'o."at",')


def _added(op, inputs: list[str]) -> Query:
    return lambda spark, sf_dir: op(*[frame(spark, sf_dir, k) for k in inputs])


#: The sections of `coded` that are not code, for the oracle.
_PROSE = "{}, flag as ({}), prosed as (select coded.* from coded join flag using (doc_id, pos) where not is_code)".format(*_ADDED["code_sections"][2].replace("marked", "coded").replace("\nselect m.", "\n|select m.").split("\n|"))
_prose = lambda name: lambda df: PROSE_PACKS[name]({"sections": df})
_ADDED |= {
    "missing_chapters": (
        lambda df: structure.missing_chapters(df, ["The", "e", "License", "参考文献"]),
        ["sections"],
        "w(x) as (values ('The'), ('e'), ('License'), ('参考文献')), d as (select distinct doc_id from sections) select d.doc_id, 'ERR_INTEGRITY_REQ_' || x rule_id, 5 severity from d, w where not exists (from sections s where s.doc_id = d.doc_id and type = 'heading' and contains(text, x))",
    ),
    "prose_layout_rules": (_prose("layout"), ["coded"], f"{_PROSE} {rules_sql('prosed', packs.LAYOUT_RULES, SECTION)}"),
    "prose_list_rules": (_prose("lists"), ["coded"], f"{_PROSE}, levels as ({duck_sql(packs.LIST_LEVEL).replace('{x}', 'prosed')}) {rules_sql('levels', packs.LIST_RULES, SECTION)}"),
    "prose_headings": (
        lambda df: _prose("jumps")(df).unionByName(_prose("reversals")(df)).where("rule_id like 'TITLE-%'"),
        ["coded"],
        f"""{_PROSE}, h as (select doc_id, pos, level, (select max_by(b.level, b.pos) from prosed b where b.doc_id = a.doc_id and b.type = 'heading' and b.pos < a.pos) b from prosed a where type = 'heading')
select doc_id, pos, case when level > b then 'TITLE-007' else 'TITLE-008' end rule_id, case when level > b then 3 else 2 end severity from h where (level > b + 1 and b > 0) or level < b - 1""",
    ),
    "prose_captions": (
        _prose("captions"),
        ["coded"],
        f"""{_PROSE}, h as (select *, coalesce((select max_by(b.text, b.pos) from prosed b where b.doc_id = a.doc_id and b.pos < a.pos), '') b from prosed a where type in ('table', 'figure'))
select doc_id, pos, 'TABLE-CAPTION-001' rule_id, 2 severity from h where type = 'table' and not regexp_matches(lower(b), '^(表\\s*[0-9]|table\\s*[0-9])') union all select doc_id, pos, 'IMAGE-CAPTION-001', 2 from h where type = 'figure' and not regexp_matches(lower(b), '^(图\\s*[0-9]|fig\\.?\\s*[0-9]|figure\\s*[0-9])')
union all select doc_id, pos, 'TABLE-CONT-001', 2 from h where type = 'table' and (page_end > page_start or (row_count > 15 and not contains(b, '续表')))""",
    ),
    "issue_merge_near": (
        lambda df: issues.near_merged_reviews(df.where("source = 0").drop("source"), df.where("source = 1").drop("source")),
        ["reviews"],
        ", ".join(
            [
                "r0 as (select * from reviews where source = 0), r1 as (select * from reviews where source = 1)",
                _near("r0", "d0", "doc_id, section_id, chunk", "at"),
                _near("r1", "d1", "doc_id, section_id, chunk", "at"),
                "u as (select * from d0 union all select * from d1)",
                _near("u", "dc", "doc_id, section_id, chunk", "source, at"),
                _near("dc", "ds", "doc_id, section_id", "chunk, source, at"),
            ]
        )
        + " select * from ds",
    ),
}

for _name, (_op, _inputs, _sql) in _ADDED.items():
    QUERIES[_name], ORACLE[_name] = _added(_op, _inputs), _with(_inputs, _sql)

QUERIES["style_inheritance"] = _added(structure.style_inheritance, ["styles"])
ORACLE["style_inheritance"] = _with(
    ["styles"],
    """c as (select doc_id, style_id, parent, 0 depth, font, size_pt from styles union all select c.doc_id, c.style_id, s.parent, depth + 1, s.font, s.size_pt from c join styles s on s.doc_id = c.doc_id and s.style_id = c.parent)
select doc_id, style_id, arg_min(font, depth) filter (font is not null) font, arg_min(size_pt, depth) filter (size_pt is not null) size_pt from c group by 1, 2""",
)


#: SQL from the definitions, in another form than the operators': look-backs as subqueries, positions as ranges, cases as tables.
_APART = {
    "heading_jump": (["sections"], """h as (select *, (select max_by(b.level, b.pos) from sections b where b.doc_id = a.doc_id and b.type = 'heading' and b.pos < a.pos) b from sections a where type = 'heading')
select doc_id, pos, level, b "before", code rule_id from h, (values ('TITLE-007'), ('FMT_HEADING_LEVEL_JUMP'), ('HIER_INT_HEADING_STRUCT_001'), ('HIER_INT_ORDER_001'), ('ERR_INTEGRITY_HIER')) c(code) where b > 0 and level - b > 1"""),
    "heading_reverse": (["sections"], """h as (select *, (select max_by(b.level, b.pos) from sections b where b.doc_id = a.doc_id and b.type = 'heading' and b.pos < a.pos) b from sections a where type = 'heading') select doc_id, pos, level, b "before", 'TITLE-008' rule_id from h where b - level > 1"""),
    "figure_numbering": (["sections"], """f as (select *, (select count(*) from sections b where b.doc_id = a.doc_id and b.type = a.type and b.pos <= a.pos)::varchar n from sections a where type in ('figure', 'table')), w(type, sign, word, code) as (values ('figure', '图', 'figure ', 'ERR_INT_FIG_001'), ('table', '表', 'table ', 'ERR_INT_TAB_001'))
select doc_id, pos, n, code rule_id from f join w using (type) where instr(text, sign || n) = 0 and instr(lower(text), word || n) = 0"""),
    "blank_runs": (["lines"], """b as (select doc_id, pos, row_number() over (partition by doc_id order by pos) i, trim(text) = '' blank from lines), r as (select *, i - coalesce((select max(c.i) from b c where c.doc_id = b.doc_id and c.i <= b.i and not c.blank), 0) k from b) select doc_id, pos, k, 'SPACE-001' rule_id from r where k > 1"""),
    "empty_line_first": (["lines"], """n as (select *, row_number() over (partition by doc_id order by pos) i from lines), t as (select a.doc_id, a.pos from n a join n b on b.doc_id = a.doc_id and b.i = a.i - 1 and trim(a.text) = '' and trim(b.text) = '') select doc_id, min(pos) pos, 'FMT_EMPTY_LINE_001' rule_id from t group by 1"""),
    "doc_presence": (["sections"], """d as (select distinct doc_id from sections) select doc_id, 'ERR_INT_STRUCT_001' rule_id from d where doc_id not in (select doc_id from sections where type = 'heading') union all select doc_id, 'REQ_INT_MISSING_SECTION_001' from d where doc_id not in (select doc_id from sections where contains(text, '摘要') or contains(lower(text), 'abstract'))"""),
    "duplicate_sections": (["repeated_ids"], """r as (select * from repeated_ids) select doc_id, pos, section_id, 'ERR_INT_DUPLICATE_001' rule_id from r where exists (from r b where b.doc_id = r.doc_id and b.section_id = r.section_id and b.pos < r.pos)"""),
    "empty_docs": (["docs", "sections"], """d as (from docs) select doc_id, 'ERR_INT_EMPTY_DATA' rule_id from d where doc_id not in (select doc_id from sections) union all select doc_id, 'ERR_INTEGRITY_NULL' from d where coalesce(title, '') = ''"""),
    "ack_missing": (["docs", "sections"], """t as (select distinct doc_id from sections where contains(text, '致谢') or contains(lower(text), 'acknowledgment') or contains(lower(text), 'acknowledgement')) select doc_id, 'ERR_INT_MISSING_ACKNOWLEDGEMENT' rule_id from docs where (contains(title, '学位论文') or contains(lower(title), 'thesis') or contains(lower(title), 'dissertation')) and doc_id not in (from t)"""),
    "missing_ref_entries": (["groups", "refs"], """g as (select *, regexp_matches(trim(cited), '^[0-9]+$') single from groups) select doc_id, pos, first_number "number", 'ERR_REF_MISSING' rule_id from g where single and first_number is not null and (doc_id, '[' || first_number || ']') not in (select (doc_id, ref_id) from refs)"""),
    "unused_ref_entries": (["edges", "refs"], """c as (select distinct doc_id, '[' || number || ']' ref_id from edges) select doc_id, ref_pos, ref_id, 'WARN_REF_UNUSED' rule_id from refs r left join c using (doc_id, ref_id) where (r.doc_id, r.ref_id) not in (select (doc_id, ref_id) from c)"""),
    "score_impact": (["issues"], """p(name, points) as (values ('CRITICAL', 10), ('HIGH', 5), ('MEDIUM', 2), ('LOW', 1)) select i.doc_id, cast(coalesce(sum(points), 0) as bigint) score from issues i left join p on name = upper(severity_name) group by 1"""),
    "audit_summary": (["issues"], """i as (select doc_id, upper(severity_name) s from issues) select doc_id, count(*) total, count(*) filter (where s in ('CRITICAL', 'HIGH')) high, count(*) filter (where s = 'MEDIUM') medium, count(*) filter (where s = 'LOW') low from i group by 1"""),
    "hybrid_merge": (["packs", "reviewed"], """r as (select distinct doc_id, section_id from reviewed) select p.doc_id, p.section_id, p.rule_id, 'packs' origin from packs p where (doc_id, section_id) not in (select (doc_id, section_id) from r) union all select doc_id, section_id, rule_id, 'review' from reviewed"""),
    "issue_dedupe_exact": (["issues"], """n as (select *, row_number() over (order by doc_id, pos, k) i from issues), f as (select min(i) i from n group by doc_id, section_id, rule_id, issue_type, severity_name, original, start_char, end_char) select doc_id, pos, k, rule_id, issue_type, original, start_char, end_char from n join f using (i)"""),
    "chunks_small": (["sections"], """s as (select *, greatest(1, ceil((length(text) - 10) / 70))::int n from sections where text <> '') select doc_id, pos, k::int k, text[k * 70 + 1 : k * 70 + 80] chunk from s, lateral (select unnest(range(0, n)) k) x"""),
    "chunks": (["sections"], """s as (select *, greatest(1, ceil((length(text) - 100) / 700))::int n from sections where text <> '') select doc_id, pos, k::int k, text[k * 700 + 1 : k * 700 + 800] chunk from s, lateral (select unnest(range(0, n)) k) x"""),
    "token_jaccard": (["text_pairs"], r"""t as (select id, unnest([0, 1]) side, unnest([a, b]) x from text_pairs), w as (select distinct id, side, unnest(regexp_extract_all(lower(x), '[\p{L}\p{N}_]+')) w from t), u as (select id, w, count(*) n from w group by 1, 2), c as (select id, count(*) filter (where n = 2) both_, count(*) all_ from u group by 1)
select p.id, coalesce(round(both_ / all_, 9), 0) jaccard from text_pairs p left join c using (id)"""),
}
for _name, (_inputs, _sql) in _APART.items():
    ORACLE[_name] = _with(_inputs, _sql)


#: Columns that are 32-bit in Spark's results and wider in the oracle's, with the queries that have them.
_NARROW = {
    "ref_pos, section_id": "ref_section_locate",
    "k": "paper_topk",
    "n": "page_top_issues",
    "number": "bidirectional_refs",
    "chunk": "report_compaction",
    "chunk, source": "issue_merge_near",
    "pos": "outside_review text_findings prose_layout_rules prose_list_rules prose_headings prose_captions code_sections audit_lines needle_positions list_rules section_page_map section_id_order keyword_needles formatting_rules strict_heading_rules layout_rules formula_table_list_rules heading_format_rules paragraph_rules heading_hier_strict figure_numbering caption_sequence caption_missing empty_line_first heading_body_spacing page_assignment size_carry_forward duplicate_sections ref_detect_fallback ref_block_extract chart_mentions citation_groups missing_ref_entries citation_order severity_norm issue_dedupe_exact chunks chunks_small span_relocate",
    "pos, expected": "chapter_ordinal",
    "pos, k": "blank_runs",
    "pos, level, before": "heading_jump heading_reverse",
    "pos, number": "citation_edges",
    "pos, section_id": "section_filter section_exclusion",
    "pos, section_id, level": "sections_from_documents",
    "ref_pos": "text_rules text_rules_by_area ref_rules_journal ref_rules_monograph ref_rules_thesis ref_rules_conference ref_rules_lines unused_ref_entries ref_numbering_gap",
    "ref_pos, author_commas": "ref_parts",
    "section_id": "issue_merge hybrid_merge issue_sections",
    "size": "task_listing",
}
for _columns, _names in _NARROW.items():
    for _name in _names.split():
        ORACLE[_name] = f"select * replace ({', '.join(f'cast({c} as int) as {c}' for c in _columns.split(', '))}) from ({ORACLE[_name]}) narrow"
