"""Checks of whole documents: required parts, structure, duplicates, metadata, captions and mentions, abbreviations, styles."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import SqlOperator
from .contained import contained_in


def required_parts(sections: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """Which of the required parts no section of a document names, here by any of a part's words in lower case: one row for each
    missing part, in one pass. A null text names none."""
    text = F.lower("text")
    has = {part: F.coalesce(F.bool_or(F.coalesce(functools.reduce(lambda a, b: a | b, [text.contains(w) for w in words]), F.lit(False))), F.lit(False)) for part, words in parts.items()}
    found = sections.groupBy("doc_id").agg(F.array_compact(F.array(*[F.when(~h, part) for part, h in has.items()])).alias("missing"))
    return found.select("doc_id", F.explode("missing").alias("part"), F.lit("ERR_INT_REQ_001").alias("rule_id"))


#: Chapters that headings must name.
CHAPTERS = ["摘要", "引言", "正文", "结论", "参考文献"]


def missing_chapters(sections: DataFrame, words: list[str] = CHAPTERS) -> DataFrame:
    """One row for each word that no heading of a document has in it, in one pass; a document without headings lacks all."""
    text = F.when(F.col("type") == "heading", F.col("text"))
    has = [F.coalesce(F.bool_or(text.contains(w)), F.lit(False)) for w in words]
    found = sections.groupBy("doc_id").agg(F.array(*[F.when(~h, w) for h, w in zip(has, words, strict=True)]).alias("missing"))
    rows = found.select("doc_id", F.explode(F.array_compact("missing")).alias("word"))
    return rows.select("doc_id", F.concat(F.lit("ERR_INTEGRITY_REQ_"), "word").alias("rule_id"), F.lit(5).alias("severity"))


#: One pass: abstract, conclusion and references present, and the last abstract after the last conclusion.
document_structure = SqlOperator(
    "sections",
    """with s as (select doc_id, max(case when rx(lower(text), «ABSTRACT») then pos end) as abstract, max(case when rx(lower(text), «CONCLUSION») then pos end) as conclusion, max(case when rx(lower(text), «REFERENCES») then pos end) as refs from {sections} group by doc_id)
select doc_id, 'ERR_INT_STRUCT_001' as rule_id from s where abstract > conclusion union all select doc_id, 'ERR_INT_STRUCT_002' from s where abstract is null
union all select doc_id, 'ERR_INT_STRUCT_003' from s where conclusion is null union all select doc_id, 'ERR_INT_STRUCT_004' from s where refs is null""",
)


def structure(abstract: str = "摘要|abstract", conclusion: str = "结论|conclusion", references: str = "参考文献|references") -> SqlOperator:
    """document_structure for other words."""
    return SqlOperator("sections", document_structure.sql.replace("ABSTRACT", abstract).replace("CONCLUSION", conclusion).replace("REFERENCES", references))


#: Documents without any heading, and without any abstract.
presence = SqlOperator(
    "sections",
    """with s as (select doc_id, max(case when type = 'heading' then 1 else 0 end) as heads, max(case when rx(lower(text), «摘要|abstract») then 1 else 0 end) as abstracts from {sections} group by doc_id)
select doc_id, 'ERR_INT_STRUCT_001' as rule_id from s where heads = 0 union all select doc_id, 'REQ_INT_MISSING_SECTION_001' from s where abstracts = 0""",
)
#: Documents (doc_id, title) without sections or without metadata.
empty_documents = SqlOperator(
    "docs sections",
    """select d.doc_id, 'ERR_INT_EMPTY_DATA' as rule_id from {docs} d where not exists (select 1 from {sections} s where s.doc_id = d.doc_id)
union all select doc_id, 'ERR_INTEGRITY_NULL' from {docs} where title is null or title = ''""",
)
#: Every repeat of a section id after its first.
duplicate_sections = SqlOperator(
    "sections",
    "select doc_id, pos, section_id, 'ERR_INT_DUPLICATE_001' as rule_id from (select doc_id, pos, section_id, row_number() over (partition by doc_id, section_id order by pos) as k from {sections}) s where k > 1",
)
#: Theses by title in which no section names an acknowledgement.
missing_acknowledgement = SqlOperator(
    "docs sections",
    """select d.doc_id, 'ERR_INT_MISSING_ACKNOWLEDGEMENT' as rule_id from {docs} d where rx(lower(title), «学位论文|thesis|dissertation»)
and not exists (select 1 from {sections} s where s.doc_id = d.doc_id and rx(lower(s.text), «致谢|acknowledge?ment»))""",
)
#: Metadata: whitespace-separated words, parts by type, formulas, pages (the largest given if any is over 1, else 20 sections a page).
document_metadata = SqlOperator(
    "sections",
    """select doc_id, cast(sum(items(regexp_extract_all(text, «[^\\s]+», 0))) as bigint) as total_words, cast(sum(case when type = 'paragraph' then 1 else 0 end) as bigint) as total_paragraphs, cast(sum(case when type = 'table' then 1 else 0 end) as bigint) as total_tables,
  coalesce(max(case when has_math then 1 else 0 end), 0) = 1 as has_math,
  cast(case when coalesce(max(greatest(coalesce(page_start, 1), coalesce(page_end, 1))), 1) > 1 then coalesce(max(coalesce(page_end, page_start)), 1) else greatest(1, ceil(count(*) / 20)) end as bigint) as total_pages,
  case when coalesce(max(greatest(coalesce(page_start, 1), coalesce(page_end, 1))), 1) > 1 then 'explicit_or_mixed' else 'estimated' end as page_mode from {sections} group by doc_id""",
)
#: Lines that look like references, of documents that have none listed.
detected_references = SqlOperator(
    "lines refs",
    """select doc_id, pos, text from {lines} l where (rx(text, «^\\[[0-9]+\\]») or (contains(text, 'et al.') and rx(text, «\\d{4}»)))
and not exists (select 1 from {refs} r where r.doc_id = l.doc_id)""",
)
#: The block of references after a section that is only the given title: up to the next table, a closing part's beginning, or a heading-like line:
#: 30 bytes at most, with a heading's style, or without punctuation and in large or bold letters.
reference_block = SqlOperator(
    "sections titles",
    """with h as (select s.doc_id, min(s.pos) as begins from {sections} s join {titles} t on regexp_replace(s.text, «^[：:]+|[：:]+$», '', 'g') = t.title group by s.doc_id),
e as (select h.doc_id, h.begins, min(s.pos) as ends from h left join {sections} s on s.doc_id = h.doc_id and s.pos > h.begins and (s.type = 'table' or rx(s.text, «^(作者简介|致谢|附录)») or (bytes(s.text) <= 30 and (contains(lower(coalesce(s.style, '')), 'heading') or (not rx(s.text, «[。.，,；;]») and (s.size_pt >= 14 or (s.bold and s.size_pt >= 12)))))) group by h.doc_id, h.begins)
select s.doc_id, s.pos, concat('[', cast(row_number() over (partition by s.doc_id order by s.pos) as string), ']') as ref_id, s.text from e join {sections} s on s.doc_id = e.doc_id and s.pos > e.begins and (e.ends is null or s.pos < e.ends)""",
)
# How charts are named in texts, as written and in lower case, before their number or alone.
_CHART_SIGNS, _CHART_WORDS = ["图", "表"], ["figure", "table"]


def unmentioned_charts(charts: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Charts (doc_id, pos, caption_number) that no paragraph (doc_id, pos, text) mentions, with ERR_INT_CHART_REF_001.

    A chart with a number is mentioned by 图, 表, figure or table and the number, with or without a blank after the words, also as
    the beginning of a longer number; one without by any of the four. Distinct names are sought by contained_in()."""
    number = F.nullif("caption_number", F.lit(""))
    forms = [F.concat(F.lit(w), F.coalesce(number, F.lit(""))) for w in _CHART_SIGNS]
    low = [F.concat(F.lit(w + blank), F.coalesce(number, F.lit(""))) for w in _CHART_WORDS for blank in ("", " ")]
    names = F.array(*[F.struct(F.lit(0).alias("low"), f.alias("name")) for f in forms], *[F.struct(F.lit(1).alias("low"), f.alias("name")) for f in low])
    asked = charts.select("doc_id", "pos", F.explode(names).alias("n")).select("doc_id", "pos", "n.low", "n.name").where("low = 0 or name not in ('figure ', 'table ')")
    out = None
    for low_, text in ((0, F.col("text")), (1, F.lower("text"))):
        some = asked.where(F.col("low") == low_)
        needles = some.select("doc_id", F.xxhash64("name").alias("needle_id"), F.col("name").alias("needle")).distinct()
        found = contained_in(needles, paragraphs.select("doc_id", F.col("pos").alias("text_id"), text.alias("text"))).select("doc_id", F.col("needle_id").alias("id")).distinct()
        hit = some.withColumn("id", F.xxhash64("name")).join(found.hint("merge"), ["doc_id", "id"]).select("doc_id", "pos")
        out = hit if out is None else out.unionByName(hit)
    left = charts.select("doc_id", "pos", "caption_number").join(out.distinct().hint("merge"), ["doc_id", "pos"], "left_anti")
    return left.withColumn("rule_id", F.lit("ERR_INT_CHART_REF_001"))


#: Abbreviations that a document uses without defining them as `Full name (ABC)`, sorted and joined.
unexpanded_abbreviations = SqlOperator(
    "lines",
    """with c as (select distinct doc_id, upper(a) as abbreviation from (select doc_id, unroll(regexp_extract_all(text, «⟦(?:[A-Z]{2,}[A-Za-z0-9]*|[A-Z][a-z]+[A-Z][A-Za-z0-9]*)⟧», 0)) as a from {lines}) x),
d as (select distinct doc_id, upper(a) as abbreviation from (select doc_id, unroll(regexp_extract_all(text, «[(（]([A-Z][A-Za-z0-9]+)[)）]», 1)) as a from {lines}) x)
select doc_id, joined(abbreviation) as abbreviations, 'CONSIST-003' as rule_id from (select /*+ merge(c, d) */ c.doc_id, c.abbreviation from c left join d on d.doc_id = c.doc_id and d.abbreviation = c.abbreviation where d.doc_id is null and length(c.abbreviation) >= 2) u group by doc_id""",
)
#: First and last section of a document as abstract and conclusion: overlap of their word sets, an issue under 0.15.
abstract_overlap = SqlOperator(
    "sections",
    """with e as (select doc_id, min(pos) as a, max(pos) as c from {sections} where type = 'paragraph' group by doc_id having min(pos) < max(pos)),
t as (select /*+ merge(e, s) */ distinct e.doc_id, case when s.pos = e.a then 'a' else 'c' end as part, w from e join (select doc_id, pos, unroll(regexp_extract_all(lower(text), «[\\p{L}\\p{N}_]+», 0)) as w from {sections}) s on s.doc_id = e.doc_id and s.pos in (e.a, e.c)),
n as (select doc_id, sum(case when part = 'a' then 1 else 0 end) as na, sum(case when part = 'c' then 1 else 0 end) as nc from t group by doc_id),
b as (select doc_id, count(*) as nb from (select doc_id, w from t group by doc_id, w having count(*) = 2) x group by doc_id)
select /*+ merge(n, b) */ n.doc_id, round(real(coalesce(nb, 0)) / greatest(na, nc), 6) as overlap, case when real(coalesce(nb, 0)) / greatest(na, nc) < 0.15 then 'CONSIST-001' end as rule_id from n left join b on n.doc_id = b.doc_id""",
)


def style_inheritance(styles: DataFrame) -> DataFrame:
    """Fields of styles (doc_id, style_id, parent, font, size_pt) resolved along their chain of parents, the nearest value winning.

    Each round a style takes over what the ancestor that it points to has found, and points to where that one points, so that
    chains of any length take the logarithm of the largest number of styles in a document; cycles end there too. A parent
    that isn't a style ends a chain."""
    most = styles.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    now = styles.select("doc_id", "style_id", F.col("parent").alias("to"), "font", "size_pt")
    for _ in range(max(0, most - 1).bit_length()):
        up = now.select("doc_id", F.col("style_id").alias("to"), F.col("to").alias("next"), F.col("font").alias("up_font"), F.col("size_pt").alias("up_size"))
        now = now.join(up.hint("merge"), ["doc_id", "to"], "left")
        now = now.select("doc_id", "style_id", F.col("next").alias("to"), F.coalesce("font", "up_font").alias("font"), F.coalesce("size_pt", "up_size").alias("size_pt"))
    return now.drop("to")


#: Sections of types other than table, and whether a section says that what follows needs no audit.
kept_sections = SqlOperator("sections", "select doc_id, pos, section_id, type, contains(text, '学位论文数据集') as stop from {sections} where lower(trim(type)) <> 'table'")
#: Sections without those that issues (doc_id, section_id) are known of.
unreviewed_sections = SqlOperator("sections issues", "select doc_id, pos, section_id from {sections} s where not exists (select 1 from {issues} i where i.doc_id = s.doc_id and i.section_id = s.section_id)")
