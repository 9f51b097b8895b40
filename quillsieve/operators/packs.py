"""Rule packs on single rows: text, table fields, layout, formatting, document type, integrity and bibliography."""

from __future__ import annotations

from dataclasses import replace

from ..functions.rules import Rule

# Rule ids, severities (1 to 5), needles, labels, patterns and limits.
TYPOS = ["图像分类种", "的的", "，，", "。。"]
COLLOQUIAL = ["非常好", "很开心", "挺好的", "听说", "basically"]
LABEL_HINTS = ["UDC", "ISBN", "ISSN", "Abstract", "Keywords", "Classification", "中图分类号", "分类号", "学校代码", "学号", "姓名", "专业", "班级", "指导教师", "答辩委员会主席", "阅人", "评阅人", "作者", "培养单位"]
SECRECY = ["公开", "内部", "秘密", "机密", "绝密"]
DEGREES = ["学士", "硕士", "博士"]
PUBLISHERS = ["出版社", "出版局", "Press", "Publisher", "Publishing"]
UNIVERSITIES = ["大学", "学院", "学校", "研究院", "University", "Institute", "College"]
CONFERENCES = ["//", "Proceedings", "Conference", "Symposium"]

LOW, MEDIUM, HIGH, CRITICAL = 2, 3, 4, 5


def needles(rule_id: str, severity: int, words: list[str], area: str, column: str = "text") -> list[Rule]:
    """One rule for each needle, case-sensitive."""
    return [Rule(rule_id, severity, f"contains({column}, '{w}')", area) for w in words]


def _any(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


_MISSING_BRACKET = "rx(text, «(^|[^\\[])[A-Z]\\]\\.»)"
_DOUBLE_BRACKET = "rx(text, «\\[\\[[A-Z]\\]\\.»)"

TEXT_RULES = [
    *needles("TYPO-001", 3, TYPOS, "typo"),
    Rule("FORMAT-004", 2, "rx(text, «(?im)^Abstract:[^\\s]»)"),
    Rule("FORMAT-006", 2, "rx(text, «(?im)^Keywords:[^\\s]»)"),
    Rule("FORMAT-005", 2, "rx(text, «(?im)^Keywords:\\s*.*;\\S»)"),
    Rule("FORMAT-001", 2, f"not {_any('text', LABEL_HINTS)} and rx(text, «[A-Za-z]+[，。；：、]»)"),
    Rule("FORMAT-002", 2, _any("text", ["Fig.", "Table", "Eq."])),
    *[Rule("STYLE-001", 2, f"contains(lower(text), '{w}')", "logic") for w in COLLOQUIAL],
    Rule("REF-002", 3, _MISSING_BRACKET, "reference"),
    Rule("REF-003", 3, _DOUBLE_BRACKET, "reference"),
    Rule("REF-001", 3, "(rx(text, «\\[\\d+\\]\\s*[^\\n]+») or rx(text, «\\b\\d{4}\\b»)) and contains(text, '参考文献') and not rx(text, «\\[[0-9]+\\].+\\d{4}»)", "reference"),
    Rule("REF-004", 3, f"rx(text, «\\[[0-9]+\\][^\\n]*[A-Za-z].*?\\d{{4}}») and ({_MISSING_BRACKET} or {_DOUBLE_BRACKET})", "reference"),
]

#: Over (name, value) pairs of cells; `required` and `bare` (the name without stars) are columns.
FIELD_RULES = [
    Rule("THESIS-FORMAT-001", 5, "required and value = ''"),
    Rule("THESIS-FORMAT-002", 5, "not (required and value = '') and value = bare"),
    Rule("ISO-8601", 3, "rx(value, «^\\d{4}年\\d{1,2}月\\d{1,2}日$»)"),
    Rule("THESIS-FORMAT-004", 2, "value = '四年'"),
    Rule("THESIS-FORMAT-004", 3, "bare = '密级' and not (required and value = '') and value not in (" + ", ".join(f"'{x}'" for x in SECRECY) + ")"),
    Rule("THESIS-FORMAT-004", 3, "bare = '学位级别' and not (required and value = '') and value not in (" + ", ".join(f"'{x}'" for x in DEGREES) + ")"),
    Rule("THESIS-FORMAT-005", 2, "contains(value, '；')"),
]

LAYOUT_RULES = [
    *[Rule(f"TITLE-00{2 * k - 1}", 3, f"type = 'heading' and level = {k} and font is not null and not rx(font, «(?i)黑体|simhei»)") for k in (1, 2, 3)],
    *[Rule(f"TITLE-00{2 * k}", 3, f"type = 'heading' and level = {k} and size_pt not between {19 - 2 * k} and {21 - 2 * k}") for k in (1, 2, 3)],
    Rule("BODY-001", 3, "type <> 'heading' and font is not null and not rx(font, «(?i)宋体|仿宋|simsun|fangsong»)"),
    Rule("BODY-002", 3, "type <> 'heading' and size_pt not between 11 and 13"),
    Rule("BODY-003", 2, "type <> 'heading' and first_line_indent not between 0.4 and 0.6"),
    Rule("LINE-001", 3, "type = 'heading' and line_spacing not between 1.45 and 1.55"),
]

#: Over sections with left_indent (inches) and style, prepared by LIST_LEVEL: list items whose indent isn't half an inch for each level, the number that the style ends with.
LIST_LEVEL = "select *, coalesce(num(digits), 1) as item_level from (select *, nullif(regexp_extract(style, «(\\d+)$», 1), '') as digits from {x}) s"
LIST_RULES = [Rule("LIST-001", 2, "(rx(text, «^(?:\\d+\\.|[一二三四五六七八九十]+[、.．]|[（(][一二三四五六七八九十]+[)）])») or contains(lower(style), 'list')) and abs(left_indent - 0.5 * item_level) > 0.2")]

FORMATTING_RULES = [
    Rule("FMT_LINE_HEIGHT_001", MEDIUM, "type in ('paragraph', 'heading') and abs(line_spacing - 1.5) > 0.05"),
    *[Rule(f"FMT_HEADING_FONT_00{k}", HIGH if k < 3 else MEDIUM, f"type = 'heading' and level = {k} and not rx(font, «SimHei|Hei|hei|黑体»)") for k in (1, 2, 3)],
    *[Rule(f"FMT_HEADING_SIZE_00{k}", MEDIUM, f"type = 'heading' and level = {k} and abs(size_pt - {20 - 2 * k}) > {tol}") for k, tol in ((1, 0.5), (2, 1), (3, 1))],
    Rule("FMT_BODY_FONT_001", MEDIUM, "type = 'paragraph' and not rx(font, «SimSun|Sun|song|Song|宋体|仿宋»)"),
    Rule("FMT_BODY_SIZE_001", MEDIUM, "type = 'paragraph' and abs(size_pt - 12) > 1"),
    Rule("FMT_INDENT_001", LOW, "type = 'paragraph' and first_line_indent < 1"),
]
#: The variants that count a missing heading font as a defect.
STRICT_HEADING_RULES = [Rule(f"FMT_HEADING_FONT_00{k}", HIGH if k < 3 else MEDIUM, f"type = 'heading' and level = {k} and coalesce(not rx(font, «(?i)simhei|hei|黑体»), true)") for k in (1, 2, 3)]

#: Over sections with the extra columns page_break, continued, confidence, alignment, has_caption, caption, indent_level, list_indent, page_number_at (text as it arrives).
LAYOUT_FLAG_RULES = [
    Rule("FMT_TABLE_PAGE_BREAK", MEDIUM, "type = 'table' and page_break = 'true' and coalesce(continued, '') <> 'true'"),
    Rule("FMT_FORMULA_ALIGNMENT", MEDIUM, "type = 'formula' and coalesce(num(confidence), 1) >= 0.8 and alignment <> 'right'"),
    Rule("FMT_PAGE_NUM_001", MEDIUM, "page_number_at is not null and page_number_at <> 'bottom-center'"),
    Rule("FMT_TABLE_CAPTION_001", MEDIUM, "type = 'table' and has_caption = 'false'"),
    Rule("FMT_IMAGE_CAPTION_001", MEDIUM, "type = 'image' and has_caption = 'false'"),
    Rule("FMT_LIST_INDENT_001", LOW, "type in ('list_item', 'list-item', 'list') and coalesce(num(indent_level), num(list_indent)) < 1"),
    Rule("FMT_FORMULA_001", MEDIUM, "type = 'formula' and coalesce(alignment, 'left') not in ('right', 'center')"),
    Rule("FMT_TABLE_001", HIGH, "type = 'table' and page_break = 'true' and continued is null and not rx(coalesce(caption, ''), «续表|continued»)"),
    Rule("FORMULA-001", 2, "type = 'formula' and lower(coalesce(alignment, '')) <> 'right'"),
]

MARGIN_RULES = [
    Rule("FMT_MARGIN_001", MEDIUM, "(margin_top > 0 and margin_top < 2.0) or (margin_bottom > 0 and margin_bottom < 2.5)"),
    Rule("FMT_MARGIN_001", MEDIUM, "margin_top > 0 and abs(margin_top - 2.5) > 0.1001"),
    Rule("FMT_MARGIN_002", MEDIUM, "margin_bottom > 0 and abs(margin_bottom - 2.5) > 0.1001"),
    Rule("MARGIN-001", 3, "margin_top not between 2.2 and 2.8"),
    Rule("MARGIN-001", 3, "margin_bottom not between 2.2 and 2.8"),
    Rule("MARGIN-001", 3, "margin_left not between 2.2 and 2.8"),
    Rule("MARGIN-001", 3, "margin_right not between 2.2 and 2.8"),
    Rule("FMT_HEADER_001", LOW, "title <> ''"),
    Rule("FMT_FOOTER_001", LOW, "title <> ''"),
]

#: By the order of tests; an empty title is `unknown`, a title without keyword a thesis.
DOC_TYPE = """case when coalesce(title, '') = '' then 'unknown' when rx(lower(title), «学位论文|thesis|dissertation») then 'thesis' when rx(lower(title), «期刊|journal|article») then 'journal'
  when rx(lower(title), «会议|conference|proceedings») then 'conference' when rx(lower(title), «专著|book») then 'book' else 'thesis' end"""
DOC_TYPE_RULES = [
    Rule("INT_TYPE_UNKNOWN", MEDIUM, "doc_type = 'unknown'"),
    Rule("INT_TYPE_MISSING_TITLE", MEDIUM, "doc_type <> 'unknown' and trim(coalesce(title, '')) = ''"),
    Rule("INT_TYPE_MISSING_PAGES", MEDIUM, "doc_type <> 'unknown' and page_count <= 0"),
    Rule("INT_THESIS_PAGES", MEDIUM, "doc_type = 'thesis' and page_count > 0 and page_count < 20"),
    Rule("INT_JOURNAL_PAGES_LONG", LOW, "doc_type = 'journal' and page_count > 50"),
    Rule("INT_CONF_PAGES_SHORT", LOW, "doc_type = 'conference' and page_count > 0 and page_count < 4"),
    Rule("INT_BOOK_PAGES_SHORT", LOW, "doc_type = 'book' and page_count > 0 and page_count < 50"),
]

INTEGRITY_RULES = [
    Rule("ERR_INT_HEADING_FORMAT_001", MEDIUM, "type = 'heading' and not rx(text, «^\\d+.*») and not rx(text, «^[一二三四五六七八九十]+[、章节].*»)"),
    Rule("ERR_INT_HEADING_FORMAT_002", LOW, "type = 'heading' and length(text) < 3"),
    Rule("ERR_INT_HEADING_FORMAT_002", LOW, "type = 'heading' and rx(text, «[.。]$»)"),
    Rule("ERR_INT_PARAGRAPH_FORMAT_001", LOW, "type = 'paragraph' and trim(text) <> '' and first_line_indent < 1"),
    Rule("ERR_INT_PARAGRAPH_FORMAT_002", LOW, "type = 'paragraph' and trim(text) <> '' and length(trim(text)) < 20"),
]

#: Over references with the columns of citations.with_parts().
_ENTRY_RULES = [
    Rule("ERR_REF_JOURNAL_FULL_COMMA", HIGH, "is_j and contains(author, '，')", "journal"),
    Rule("ERR_REF_JOURNAL_YEAR_EXCEED", HIGH, "is_j and journal_late", "journal"),
    Rule("ERR_REF_JOURNAL_NO_DOT", HIGH, "is_j and not contains(raw_text, '[J].') and not contains(raw_text, '[J]。')", "journal"),
    Rule("ERR_REF_JOURNAL_NO_VOLUME", MEDIUM, "is_j and not rx(no_doi, «\\d+\\(\\d+\\)»)", "journal"),
    Rule("ERR_REF_JOURNAL_NO_PAGE", MEDIUM, "is_j and not rx(no_doi, «\\d+-\\d+»)", "journal"),
    Rule("ERR_REF_JOURNAL_MULTI_AUTHOR", MEDIUM, "is_j and author_commas >= 3 and not rx(author, «等|et al»)", "journal"),
    Rule("ERR_REF_JOURNAL_YEAR_EARLY", MEDIUM, "is_j and journal_early", "journal"),
    Rule("ERR_REF_JOURNAL_LOWERCASE", MEDIUM, "contains(raw_text, '[j]')", "journal"),
    Rule("ERR_REF_JOURNAL_YEAR_TWO_DIGIT", MEDIUM, "is_j and rx(year_window, «[,，\\s]\\d{2}[,，.\\s:：]»)", "journal"),
    Rule("ERR_REF_JOURNAL_NO_AUTHOR", HIGH, "is_j and (first_segment is null or contains(first_segment, '[J]') or not (rx(first_segment, «[一-龥]») or rx(first_segment, «[A-Z]{2,}»)))", "journal"),
    Rule("ERR_REF_MONO_FULL_PERIOD", MEDIUM, "is_m and contains(raw_text, '。')", "monograph"),
    Rule("ERR_REF_MONO_YEAR_EXCEED", HIGH, "is_m and monograph_late", "monograph"),
    Rule("ERR_REF_MONO_YEAR_EXCEED", HIGH, "is_d and thesis_late", "monograph"),
    Rule("ERR_REF_MONO_NO_DOT", HIGH, "is_m and not contains(raw_text, '[M].') and not contains(raw_text, '[M]。')", "monograph"),
    Rule("ERR_REF_MONO_NO_PUBLISHER", HIGH, f"is_m and not ({_any('raw_text', PUBLISHERS)} and rx(raw_text, «[:：]»))", "monograph"),
    Rule("ERR_REF_MONO_NO_PLACE", HIGH, f"is_m and {_any('raw_text', PUBLISHERS)} and not rx(raw_text, «[:：]»)", "monograph"),
    Rule("ERR_REF_MONO_MULTI_AUTHOR", MEDIUM, "is_m and author_commas >= 3 and not rx(author, «等|et al»)", "monograph"),
    Rule("ERR_REF_MONO_YEAR_EARLY", MEDIUM, "is_m and monograph_early", "monograph"),
    Rule("ERR_REF_MONO_YEAR_TWO_DIGIT", MEDIUM, "is_m and rx(no_doi, «[,，\\s]\\d{2}[,，.\\s:：]»)", "monograph"),
    Rule("ERR_REF_MONO_NO_AUTHOR", HIGH, "is_m and (first_segment is null or contains(first_segment, '[M]'))", "monograph"),
    Rule("ERR_REF_THESIS_NO_UNIVERSITY", HIGH, f"is_d and not {_any('raw_text', UNIVERSITIES)}", "thesis"),
    Rule("ERR_REF_THESIS_NO_YEAR", HIGH, "is_d and not rx(no_doi, «(19|20)\\d{2}»)", "thesis"),
    Rule("ERR_REF_CONF_NO_PLACE", MEDIUM, "is_c and not rx(raw_text, «[一-鿿]{2,}[,，]\\s*(19|20)\\d{2}|[A-Z][a-z]+[,，]\\s*(19|20)\\d{2}»)", "conference"),
    Rule("ERR_REF_CONF_NO_NAME", HIGH, f"is_c and not {_any('raw_text', CONFERENCES)}", "conference"),
]
#: Entries without a number of their own are passed over.
REFERENCE_RULES = [replace(r, predicate=f"ref_num > 0 and ({r.predicate})") for r in _ENTRY_RULES]

#: The other set of bibliography rules; kind is `J` or `M` by the first mark, years are whole 4-digit numbers.
REFERENCE_LINE_RULES = [
    Rule("REF-J-001", 2, "kind = 'J' and contains(raw_text, '，')"),
    Rule("REF-J-003", 2, "kind = 'J' and not contains(raw_text, '[J].')"),
    Rule("REF-J-004", 2, "kind = 'J' and not rx(raw_text, «\\d+\\s*\\(\\s*\\d+\\s*\\)»)"),
    Rule("REF-J-005", 2, "kind = 'J' and not rx(raw_text, «\\d{1,4}\\s*-\\s*\\d{1,4}»)"),
    Rule("REF-J-006", 2, "kind = 'J' and authors > 2 and not rx(raw_text, «(?i)等|et al\\.»)"),
    Rule("REF-J-007", 3, "kind = 'J' and year_max > 2026"),
    Rule("REF-J-009", 3, "kind = 'J' and year_min < 1900"),
    Rule("REF-J-011", 3, "kind = 'J' and year_max is null and rx(raw_text, «(^|[^0-9])[0-9]{2}($|[^0-9])»)"),
    Rule("REF-M-001", 3, "kind = 'M' and year_min < 1900"),
    Rule("REF-M-002", 3, "kind = 'M' and year_max is null and rx(raw_text, «(^|[^0-9])[0-9]{2}($|[^0-9])»)"),
]
