"""Rules over the order of sections: each is one window over (doc_id, pos). Only narrow columns are sorted."""

from __future__ import annotations

from ..functions.sql import SqlOperator

_HEADS = "select doc_id, pos, section_id, level, text, lag(level) over (partition by doc_id order by pos) as before from {sections} where type = 'heading'"

#: A heading more than one level below the one before it; all codes that say so.
heading_jumps = SqlOperator(
    "sections",
    f"""select doc_id, pos, level, before, unroll(many('TITLE-007', 'FMT_HEADING_LEVEL_JUMP', 'HIER_INT_HEADING_STRUCT_001', 'HIER_INT_ORDER_001', 'ERR_INTEGRITY_HIER')) as rule_id from ({_HEADS}) h where level > before + 1 and before > 0""",
)
#: A heading more than one level above the one before it.
heading_reversals = SqlOperator("sections", f"select doc_id, pos, level, before, 'TITLE-008' as rule_id from ({_HEADS}) h where level + 1 < before")
#: Strict hierarchy: before the first heading the level is 0; at one level section ids must rise.
heading_hierarchy = SqlOperator(
    "sections",
    """with h as (select doc_id, pos, section_id, level, lag(level, 1, 0) over (partition by doc_id order by pos) as before, lag(section_id, 1, 0) over (partition by doc_id order by pos) as id_before from {sections} where type = 'heading')
select doc_id, pos, 'ERR_INT_HIER_001' as rule_id from h where level > before + 1 union all select doc_id, pos, 'ERR_INT_HIER_002' from h where level = before and section_id <= id_before""",
)
#: Section ids that don't rise.
section_id_order = SqlOperator(
    "sections",
    "select doc_id, pos, section_id, 'ERR_INT_NUM_001' as rule_id from (select doc_id, pos, section_id, lag(section_id, 1, -1) over (partition by doc_id order by pos) as before from {sections}) s where section_id <= before",
)
_ORDINAL = "case n " + " ".join(f"when {k} then '{c}'" for k, c in enumerate("零一二三四五六七八九十")) + " else '' end"
#: The first top-level heading without its ordinal, in digits or as a Chinese numeral up to ten.
chapter_ordinals = SqlOperator(
    "sections",
    f"""with h as (select doc_id, pos, text, row_number() over (partition by doc_id order by pos) as n from {{sections}} where type = 'heading' and level = 1),
w as (select *, row_number() over (partition by doc_id order by pos) as k from h where not contains(text, cast(n as string)) and not ({_ORDINAL} <> '' and contains(text, {_ORDINAL})))
select doc_id, pos, n as expected, 'ERR_INT_SECTION_NUM_001' as rule_id from w where k = 1""",
)
#: The nth figure or table of a document whose text doesn't name its number.
figure_numbering = SqlOperator(
    "sections",
    """select doc_id, pos, n, case type when 'figure' then 'ERR_INT_FIG_001' else 'ERR_INT_TAB_001' end as rule_id
from (select doc_id, pos, type, lower(text) as low, cast(row_number() over (partition by doc_id, type order by pos) as string) as n from {sections} where type in ('figure', 'table')) s
where not case type when 'figure' then contains(low, concat('图', n)) or contains(low, concat('figure ', n)) else contains(low, concat('表', n)) or contains(low, concat('table ', n)) end""",
)
_IN_TEXT, _PLAIN_IN_TEXT = "(?:图|表|Figure|Table)\\s*(\\d+\\.\\d+)", "(?:图|表|Figure|Table)\\s*(\\d+)(?:[^.\\d]|$)"
#: Caption numbers (doc_id, pos, caption, text), `chapter.n` or `n`, else the first such number after a figure's or table's name in the
#: text, that don't go up by one within their chapter; two codes each. Numbers beyond 32 bits are none.
caption_sequence = SqlOperator(
    "captions",
    f"""with c as (select doc_id, pos, trim(coalesce(caption, '')) as c, coalesce(text, '') as t from {{captions}}),
p as (select doc_id, pos, case when rx(c, «^\\d+\\.\\d+$») then c when rx(c, «^\\d+$») then concat('0.', c) when rx(t, «{_IN_TEXT}») then regexp_extract(t, «{_IN_TEXT}», 1) when rx(t, «{_PLAIN_IN_TEXT}») then concat('0.', regexp_extract(t, «{_PLAIN_IN_TEXT}», 1)) end as number from c),
s as (select doc_id, pos, try_cast(regexp_extract(number, «^(\\d+)», 1) as int) as chapter, try_cast(regexp_extract(number, «(\\d+)$», 1) as int) as n from p where number is not null),
e as (select *, lag(n, 1, 0) over (partition by doc_id, chapter order by pos) + 1 as expected from s where n is not null and chapter is not null)
select doc_id, pos, chapter, n, expected, unroll(many('ERR_INT_CHART_NUM_001', 'ERR_INT_FIGURE_NUM_SKIP')) as rule_id from e where n <> expected""",
)
#: Tables and figures that no caption stands before; a table over two pages, or of over 15 rows and not marked as continued.
missing_captions = SqlOperator(
    "sections",
    """with p as (select doc_id, pos, type, text, row_count, page_start, page_end, coalesce(lag(text) over (partition by doc_id order by pos), '') as before from {sections})
select doc_id, pos, 'TABLE-CAPTION-001' as rule_id from p where type = 'table' and not rx(before, «(?i)^(表\\s*\\d+|Table\\s*\\d+)»)
union all select doc_id, pos, 'IMAGE-CAPTION-001' from p where type = 'figure' and not rx(before, «(?i)^(图\\s*\\d+|Fig\\.?\\s*\\d+|Figure\\s*\\d+)»)
union all select doc_id, pos, 'TABLE-CONT-001' from p where type = 'table' and (page_end > page_start or (row_count > 15 and not contains(before, '续表')))""",
)
#: Runs of blank lines (doc_id, pos, text): the second and later ones of a run, numbered in it.
blank_runs = SqlOperator(
    "lines",
    """with i as (select doc_id, pos, trim(text) = '' as blank, sum(case when trim(text) = '' then 0 else 1 end) over (partition by doc_id order by pos) as island from {lines}),
r as (select doc_id, pos, row_number() over (partition by doc_id, island order by pos) as k from i where blank)
select doc_id, pos, k, 'SPACE-001' as rule_id from r where k > 1""",
)
#: The first place with two empty lines in a row, once for a document.
first_empty_lines = SqlOperator(
    "lines",
    """select doc_id, min(pos) as pos, 'FMT_EMPTY_LINE_001' as rule_id from (select doc_id, pos, trim(text) = '' as blank, lag(trim(text) = '') over (partition by doc_id order by pos) as before from {lines}) l where blank and before group by doc_id""",
)
#: Paragraphs right after a heading with spacing before them under 0.1, and headings whose spacing to the next section
#: that is neither blank nor a table or figure lies outside 3.6 to 8.4 points.
heading_spacing = SqlOperator(
    "sections",
    """with s as (select doc_id, pos, type, space_before, space_after, lag(type) over (partition by doc_id order by pos) as type_before,
  type not in ('table', 'figure') and trim(coalesce(text, '')) <> '' as written from {sections}),
w as (select *, lead(space_before) over (partition by doc_id order by pos) as next_before, lead(type) over (partition by doc_id order by pos) as next_type from s where written)
select doc_id, pos, 'FMT_SPACING_001' as rule_id from s where type = 'paragraph' and type_before = 'heading' and space_before < 0.1
union all select doc_id, pos, 'SPACE-002' from w where type = 'heading' and next_type is not null and coalesce(space_after, next_before) not between 3.6 and 8.4""",
)
#: Pages: explicit breaks (pages begin after a break), else 20 sections a page.
page_assignment = SqlOperator(
    "sections",
    """with b as (select doc_id, pos, page_break, sum(case when page_break then 1 else 0 end) over (partition by doc_id) as breaks, coalesce(sum(case when page_break then 1 else 0 end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as before, row_number() over (partition by doc_id order by pos) as n from {sections})
select doc_id, pos, cast(case when breaks > 0 then before + 1 else floor((n - 1) / 20) + 1 end as int) as page from b""",
)
#: A missing size is the last one known on the page, else the last known in the document, else 10.5.
carried_sizes = SqlOperator(
    "sections",
    """select doc_id, pos, coalesce(size_pt, last_value_known(size_pt) over (partition by doc_id, page order by pos rows between unbounded preceding and current row), last_value_known(size_pt) over (partition by doc_id order by pos rows between unbounded preceding and current row), real(10.5)) as size_pt from {sections}""",
)
