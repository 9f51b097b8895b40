"""References and in-text citations: parts of entries, citation edges, and both ways of comparing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sql import SqlOperator

# How years of entries look and what must not stand around them, the last year that can be, and the delimiters of years.
LAST_YEAR, FIRST_YEAR = 2026, 1900
_DELIMITED = r"[,，\s]({})[,，.\s:：]"
#: A year in digits of its own, with an issue in parentheses; the first branch takes those after `(` or like `2301.12345`.
_JOURNAL_YEAR = r"(?<!\d)(?:(?:(?<=\()(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}(?=\.\d))(?:\([^)]*\))?(?!\d)|((?:19|20)[0-9]{2})(?:\([^)]*\))?(?!\d))"
#: A delimited year; the first branch takes those with ISBN in the ten characters before.
_MONOGRAPH_YEAR = r"[,，\s](?:(?<=(?:ISBN|isbn).{0,6})(?:19|20)\d{2}|((?:19|20)\d{2}))[,，.\s:：]"


def reference_number(ref_id: Column) -> Column:
    """The number of an id like `[n]`: a whole number of 32 bits without its brackets, else 0."""
    plain = F.trim(F.regexp_replace(ref_id, r"[\[\]]", ""))
    return F.coalesce(F.when(plain.rlike(r"^[+-]?[0-9]{1,10}$"), plain.try_cast("int")), F.lit(0))


def _any_year(text: Column, pattern: str, test) -> Column:
    """Whether some year that the pattern's group takes passes the test."""
    return F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda y: (y != "") & test(y.cast("int")))


def with_parts(refs: DataFrame) -> DataFrame:
    """refs (doc_id, ref_pos, ref_id, raw_text) -> the columns that the bibliography rules test, one pass; a null text has nulls.

    ref_num is 0 for an id without a number, and the rules pass such entries over. Years count wherever they stand in their part
    of the text: *_late beyond LAST_YEAR, *_early before FIRST_YEAR."""
    df = refs.select("doc_id", "ref_pos", "ref_id", "raw_text")
    before = lambda c, mark: F.when(F.instr(c, mark) > 0, F.col(c).substr(F.lit(1), F.instr(c, mark) - 1)).otherwise(F.col(c))
    doi = F.instr(F.lower("raw_text"), "doi")
    df = df.withColumn("no_doi", F.when(doi > 0, F.col("raw_text").substr(F.lit(1), doi - 1)).otherwise(F.col("raw_text")))
    body = F.when(F.instr("no_doi", "] ") > 0, F.col("no_doi").substr(F.instr("no_doi", "] ") + 2, F.length("no_doi"))).otherwise(F.col("no_doi"))
    df = df.withColumn("body", body)
    df = df.withColumns({"year_window": before("body", ":"), "author": before("body", ". "), "first_segment": F.when(F.instr("body", ". ") > 1, F.col("body").substr(F.lit(1), F.instr("body", ". ") - 1))})
    late, early = lambda y: y > LAST_YEAR, lambda y: y < FIRST_YEAR
    recent, old = _DELIMITED.format(r"(?:19|20)\d{2}"), _DELIMITED.format(r"(?:1[0-8]|19)\d{2}")
    commas = F.length("author") - F.length(F.translate("author", ",，", ""))
    marks = {f"is_{m.lower()}": F.col("raw_text").contains(f"[{m}]") for m in "JMDC"}
    years = {"journal_late": (_JOURNAL_YEAR, "year_window", late), "journal_early": (old, "year_window", early), "monograph_late": (_MONOGRAPH_YEAR, "year_window", late), "thesis_late": (recent, "no_doi", late), "monograph_early": (old, "no_doi", early)}
    return df.withColumns({"ref_num": reference_number(F.col("ref_id")), **marks, "author_commas": commas, **{k: _any_year(F.col(c), p, t) for k, (p, c, t) in years.items()}})


# Patterns of whole years, of authors' separators and of citation groups in the SQL below.
#: refs -> (kind, authors, year_min, year_max): the first of the marks [J] and [M], the author count, least and largest whole 4-digit number.
reference_facts = SqlOperator(
    "refs",
    """select doc_id, ref_pos, raw_text, case when instr(raw_text, '[J]') > 0 and (instr(raw_text, '[M]') = 0 or instr(raw_text, '[J]') < instr(raw_text, '[M]')) then 'J' when instr(raw_text, '[M]') > 0 then 'M' end as kind,
  greatest(items(regexp_extract_all(head, «[^，,、;；]*[^，,、;；\\s][^，,、;；]*», 0)), 1) as authors, lowest(years) as year_min, highest(years) as year_max
from (select *, regexp_extract(raw_text, «^\\[[0-9]+\\] ([^.\\[]*)», 1) as head, try_cast(regexp_extract_all(regexp_replace(raw_text, «[0-9]{5,}», ' ', 'g'), «[0-9]{4}», 0) as int[]) as years from {refs}) a""",
)

#: sections of text (doc_id, pos, text) -> citation groups in reading order: `cited` as written, first and last of a range, least and largest of a list.
#: joint: the first of the marks - – , in the group, a space where numbers have only white space between them, '' for a single number.
citation_groups = SqlOperator(
    "cites",
    """with a as (select doc_id, pos, regexp_extract_all(text, «\\[\\s*([0-9]+(?:\\s*[-–]\\s*[0-9]+|[,\\s]+[0-9]+)*)\\s*\\]», 1) as found from {cites}),
b as (select doc_id, pos, ord, nth(found, ord) as cited from (select doc_id, pos, found, unroll(span(0, items(found) - 1)) as ord from a where items(found) > 0) x),
c as (select *, try_cast(regexp_extract_all(cited, «[0-9]+», 0) as int[]) as numbers, rx(cited, «^[0-9]+\\s*[-–]\\s*[0-9]+$») as is_range from b)
select doc_id, pos, cast(ord as int) as ord, case when is_range then nth(numbers, 0) else lowest(numbers) end as first_number, case when is_range then nth(numbers, 1) else highest(numbers) end as last_number,
  case when rx(cited, «^[0-9]+$») then '' else coalesce(nullif(regexp_extract(cited, «[-–,]», 0), ''), ' ') end as joint, cited from c""",
)

#: groups -> cited numbers (doc_id, pos, number): of each part of a list the number, or all of a range that goes up and both ends of one that goes down.
#: White space around a dash is part of the range. Numbers beyond 32 bits are left out.
citation_edges = SqlOperator(
    "groups",
    """with p as (select doc_id, pos, unroll(regexp_extract_all(cited, «[0-9]+(?:\\s*[-–]\\s*[0-9]+)?», 0)) as part from {groups}),
n as (select doc_id, pos, try_cast(regexp_extract(part, «^[0-9]+», 0) as int) as a, try_cast(regexp_extract(part, «[0-9]+$», 0) as int) as b from p)
select doc_id, pos, unroll(case when a <= b then span(a, b) else many(a, b) end) as number from n where a is not null and b is not null""",
)

def compared_numbers(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, number, listed, cited) for each number over 0 that a document lists, cites or both: one union and one aggregation
    instead of joins, so that a document with very many citations is counted before the shuffle. An entry's number is
    the one that its text begins with, else that of its id."""
    begins = F.regexp_extract("raw_text", r"^\s*\[([0-9]{1,10})\]", 1).try_cast("int")
    listed = refs.select("doc_id", F.coalesce(begins, reference_number(F.col("ref_id"))).alias("number"), F.lit(True).alias("listed"), F.lit(False).alias("cited"))
    cited = edges.select("doc_id", "number", F.lit(False).alias("listed"), F.lit(True).alias("cited"))
    return listed.unionByName(cited).where("number > 0").groupBy("doc_id", "number").agg(F.bool_or("listed").alias("listed"), F.bool_or("cited").alias("cited"))


def _one_sided(edges: DataFrame, refs: DataFrame, rule_id: str, has: str, lacks: str) -> DataFrame:
    numbers = F.sort_array(F.collect_list(F.when(F.col(has) & ~F.col(lacks), F.col("number"))))
    by_doc = compared_numbers(edges, refs).groupBy("doc_id").agg(numbers.alias("found"), F.bool_or("listed").alias("lists"), F.bool_or("cited").alias("cites"))
    return by_doc.where("lists and cites and size(found) > 0").select("doc_id", F.lit(rule_id).alias("rule_id"), F.array_join(F.col("found").cast("array<string>"), ",").alias("numbers"))


def missing_references(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Numbers, in order, that are cited but not listed, one row for each document that has both."""
    return _one_sided(edges, refs, "REF-CONSIST-001", "cited", "listed")


def unused_references(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Numbers, in order, that are listed but not cited, one row for each document that has both."""
    return _one_sided(edges, refs, "REF-CONSIST-002", "listed", "cited")


def bidirectional_references(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """A row for each number that only one side has."""
    rule = F.when(F.col("cited"), "REF_MISSING_001").otherwise("REF_UNUSED_001")
    return compared_numbers(edges, refs).where("listed <> cited").select("doc_id", "number", rule.alias("rule_id"))


#: Single citations `[n]` without an entry, one row each.
missing_entries = SqlOperator(
    "groups refs",
    """select g.doc_id, g.pos, g.first_number as number, 'ERR_REF_MISSING' as rule_id from {groups} g
where g.joint = '' and g.first_number is not null and not exists (select 1 from {refs} r where r.doc_id = g.doc_id and r.ref_id = concat('[', cast(g.first_number as string), ']'))""",
)
#: Entries that nothing cites, one row each.
unused_entries = SqlOperator(
    "edges refs",
    """select r.doc_id, r.ref_pos, r.ref_id, 'WARN_REF_UNUSED' as rule_id from {refs} r
where not exists (select 1 from {edges} e where e.doc_id = r.doc_id and concat('[', cast(e.number as string), ']') = r.ref_id)""",
)
#: The first citation group of a document that begins below the largest number before it.
citation_order = SqlOperator(
    "groups",
    """with g as (select *, lag(last_number) over (partition by doc_id order by pos, ord) as before from {groups}),
v as (select *, row_number() over (partition by doc_id order by pos, ord) as k from g where first_number < before)
select doc_id, pos, first_number, before, 'REF_ORDER_001' as rule_id from v where k = 1""",
)


def reference_order(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Documents whose references, as first cited, come in another order than listed, and how many are out of place. Numbers of
    entries are their ids'; those without one are passed over."""
    none = F.lit(None).cast("long")
    listed = refs.select("doc_id", reference_number(F.col("ref_id")).alias("number"), F.col("ref_pos").cast("long").alias("place"), none.alias("seen")).where("number > 0")
    seen = edges.select("doc_id", "number", none.alias("place"), F.col("pos").cast("long").alias("seen"))
    both = listed.unionByName(seen).groupBy("doc_id", "number").agg(F.min("place").alias("place"), F.min("seen").alias("seen")).where("place is not null and seen is not null")
    rank = lambda *order: F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    out = both.withColumn("a", rank("seen", "number")).withColumn("b", rank("place")).where("a <> b")
    return out.groupBy("doc_id").agg(F.count("*").alias("out_of_place")).withColumn("rule_id", F.lit("REF_ORDER_001"))


def reference_numbering(refs: DataFrame) -> DataFrame:
    """The first entry of a list whose number is not its place; an id without a number counts as 0."""
    wrong = refs.select("doc_id", "ref_pos", reference_number(F.col("ref_id")).alias("number")).where("number <> ref_pos")
    first = F.min_by(F.struct("ref_pos", "number"), "ref_pos")
    return wrong.groupBy("doc_id").agg(first.alias("r")).select("doc_id", "r.ref_pos", "r.number", F.lit("REF_ORDER_002").alias("rule_id"))
