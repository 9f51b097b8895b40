"""Issue algebra: normalise, deduplicate exactly and nearly, relocate spans, merge reviewers and packs, rank for a page."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.sql import SqlOperator

#: Severity names to scores, issue types from code prefixes, clamped severities.
normalised = SqlOperator(
    "issues",
    """select doc_id, pos, k, rule_id, case upper(severity_name) when 'CRITICAL' then 5 when 'HIGH' then 4 when 'MEDIUM' then 3 when 'LOW' then 2 else 1 end as severity,
  case lower(severity_name) when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'normal' then 2 when 'low' then 1 else 0 end as report_order,
  case when rx(rule_id, «^(FORMAT|THESIS)») then 'format' when rx(rule_id, «^REF») then 'reference' when rx(rule_id, «^(CONSIST|STYLE|LOGIC|INTEGRITY)») then 'logic' else 'rule' end as issue_type,
  least(greatest(raw_severity, 1), 5) as clamped, nullif(original, '') as original from {issues}""",
)
#: Of issues with equal signatures the first.
distinct_issues = SqlOperator(
    "issues",
    """select doc_id, pos, k, rule_id, issue_type, original, start_char, end_char from (select *, row_number() over (partition by doc_id, section_id, rule_id, issue_type, severity_name, original, start_char, end_char order by pos, k) as n from {issues}) i where n = 1""",
)


def _sweep(keys: list[str], tolerance: int):
    """Rows sorted by keys and order -> those that stay. Kept spans lie in cells of tolerance + 1 by tolerance + 1 characters: two in one
    cell would be near, so a cell has one, and a row looks at nine."""

    def rows(batches):
        group, cells, bare = None, {}, False
        size = tolerance + 1
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "start_char", "end_char")]
            keep = []
            for *key, s, e in zip(*columns, strict=True):
                if key != group:
                    group, cells, bare = key, {}, False
                if s is None or e is None:
                    stays = not cells and not bare
                    bare |= stays
                else:
                    x, y = s // size, e // size
                    near = bare or any(f is not None and abs(f[0] - s) <= tolerance and abs(f[1] - e) <= tolerance for i in (x - 1, x, x + 1) for j in (y - 1, y, y + 1) for f in (cells.get((i, j)),))
                    stays = not near
                    if stays:
                        cells[x, y] = (s, e)
                keep.append(stays)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows


def near_distinct_issues(issues: DataFrame, scope: list[str], tolerance: int = 3) -> DataFrame:
    """Keep an issue unless one that is kept before it (by `at`) has its scope, type and label and a span within `tolerance`
    characters at both ends, or one of the two has no span (a start or an end is missing). `at` is a whole number or a struct of several;
    equal ones go by span, nulls first.

    One pass over the rows sorted by group and order: a task keeps the kept spans of the group at hand, two numbers each, and every
    row takes the same few steps, so that a group of a million issues is no array and no square."""
    keys = [*scope, "issue_type", "label"]
    if not isinstance(issues.schema["at"].dataType, StructType):
        issues = issues.withColumn("at", F.col("at").cast("bigint"))
    rows = issues.select(*keys, "at", F.col("start_char").cast("int").alias("start_char"), F.col("end_char").cast("int").alias("end_char"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "at", "start_char", "end_char").mapInArrow(_sweep(keys, tolerance), rows.schema)


def near_merged_reviews(first: DataFrame, second: DataFrame, tolerance: int = 3) -> DataFrame:
    """Issues of two reviewers (doc_id, section_id, chunk, at, issue_type, label, start_char, end_char) without near copies: each
    reviewer's in a chunk, then both's with the first reviewer's in front, then those of a section in order of its chunks.
    Adds source, 0 for the first reviewer and 1 for the second."""
    chunk = ["doc_id", "section_id", "chunk"]
    order = lambda df, k: df.withColumn("at", F.struct(F.lit(k).alias("source"), F.col("at").cast("bigint").alias("at")))
    each = [near_distinct_issues(order(df, k), chunk, tolerance) for k, df in enumerate((first, second))]
    chunks = near_distinct_issues(each[0].unionByName(each[1]), chunk, tolerance)
    sections = near_distinct_issues(chunks.withColumn("at", F.struct("chunk", F.col("at.source").alias("source"), F.col("at.at").alias("at"))), chunk[:2], tolerance)
    return sections.select("doc_id", "section_id", "at.chunk", "at.source", "at.at", "issue_type", "label", "start_char", "end_char")


def relocated_spans(rows: DataFrame) -> DataFrame:
    """(text, original, start_char, end_char) -> the place of `original` in the text nearest to the span, the first on a tie,
    where the span is missing, too short or says something else; adds new_start and new_end (null if it isn't in the text).

    The nearest places are the first one from the span's start on and, in the reversed text, the first one before it: two searches,
    however long the text. A missing start counts as 0."""
    at, n, size = F.greatest(F.coalesce("start_char", F.lit(0)), F.lit(0)), F.length("text"), F.length("original")
    find = lambda what, where, start: F.nullif(F.call_function("locate", what, where, start), F.lit(0)) - 1
    after = find(F.col("original"), F.col("text"), at + 1)
    before = n - size - find(F.reverse("original"), F.reverse("text"), F.greatest(n - size - at, F.lit(0)) + 1)
    best = F.when(before.isNotNull() & (after.isNull() | (F.abs(at - before) <= F.abs(after - at))), before).otherwise(after)
    good = F.coalesce(F.col("text").substr(F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("original"), F.lit(False))
    rows = rows.withColumn("new_start", F.when(good, F.col("start_char")).otherwise(F.when(size > 0, best)))
    return rows.withColumn("new_end", F.col("new_start") + F.length("original"))


#: Two reviewers: the first one's issues, then those of the second that it has not found (same section, rule and span).
merged_reviews = SqlOperator(
    "first second",
    """select doc_id, section_id, rule_id, start_char, min(source) as source, count(*) as found from (select doc_id, section_id, rule_id, start_char, 1 as source from {first} union all select doc_id, section_id, rule_id, start_char, 2 from {second}) u group by doc_id, section_id, rule_id, start_char""",
)
#: Pack results for the sections that the second reviewer left out, and all of the second reviewer's.
hybrid_merge = SqlOperator(
    "packs reviewed",
    """select doc_id, section_id, rule_id, 'packs' as origin from {packs} p where not exists (select 1 from {reviewed} r where r.doc_id = p.doc_id and r.section_id = p.section_id)
union all select doc_id, section_id, rule_id, 'review' from {reviewed}""",
)
#: Issues counted at their sections; those of unknown sections, and those without one, at the document.
attached_issues = SqlOperator(
    "sections issues",
    """select s.doc_id, s.section_id, 'section' as kind, count(i.rule_id) as n from {sections} s left join {issues} i on i.doc_id = s.doc_id and i.section_id = s.section_id group by s.doc_id, s.section_id
union all select i.doc_id, cast(null as int), 'document', count(*) from {issues} i where not exists (select 1 from {sections} s where s.doc_id = i.doc_id and s.section_id = i.section_id) group by i.doc_id""",
)
#: Per page the most severe issues, as many as 0.8 of the height holds at 42 points each, and how many more there are.
page_top_issues = SqlOperator(
    "issues",
    """with r as (select doc_id, page, severity, y, issue_type, message, row_number() over (partition by doc_id, page order by severity desc, y, issue_type, message, pos, k) as n, count(*) over (partition by doc_id, page) as total, greatest(1, floor(0.8 * height / 42)) as room from {issues})
select doc_id, page, n, severity, issue_type, message, big(greatest(0, total - room)) as overflow, case when total > room then 'summary' else 'sidebar' end as mode, concat('[', cast(severity as string), '] ', issue_type, ': ', case when length(message) > 20 then concat(substring(message, 1, 20), '...') else message end) as note from r where n <= room""",
)
