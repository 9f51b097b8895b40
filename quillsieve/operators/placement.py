"""Placing references and issues: references at sections, sections on pages, notes on pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql import SqlOperator
from .contained import contained_in

#: Characters of an entry that are looked for where the whole entry isn't found.
ENTRY_HEAD = 120


def compact(text: Column) -> Column:
    """A text in lower case and without white space."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def reference_sections(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """For each reference the first section of its document whose text, without white space, holds the reference's or its
    first 120 characters, or lies inside it: doc_id, ref_pos, section_id. Needles are found by contained_in(), both ways.

    Null and blank texts are in none and hold none."""
    r = refs.select("doc_id", "ref_pos", compact(F.col("raw_text")).alias("t"))
    s = sections.select("doc_id", "pos", "section_id", compact(F.col("text")).alias("t"))
    heads = r.select("doc_id", F.col("ref_pos").alias("needle_id"), F.substring("t", 1, ENTRY_HEAD).alias("needle"))  # what holds a whole entry holds its head
    found = contained_in(heads, s.select("doc_id", F.col("pos").alias("text_id"), F.col("t").alias("text"))).select("doc_id", F.col("needle_id").alias("ref_pos"), F.col("text_id").alias("pos"))
    back = contained_in(s.select("doc_id", F.col("pos").alias("needle_id"), F.col("t").alias("needle")), r.select("doc_id", F.col("ref_pos").alias("text_id"), F.col("t").alias("text")))
    found = found.unionByName(back.select("doc_id", F.col("text_id").alias("ref_pos"), F.col("needle_id").alias("pos")))
    first = found.groupBy("doc_id", "ref_pos").agg(F.min("pos").alias("pos"))
    out = first.join(s.select("doc_id", "pos", "section_id").hint("merge"), ["doc_id", "pos"])
    return out.select("doc_id", F.col("ref_pos").cast(refs.schema["ref_pos"].dataType).alias("ref_pos"), "section_id")


def _forward(batches):
    """Rows sorted by document and place, with the sorted numbers of pages that hold them -> the page of each, sought forward from
    the last one found and then from the first on. Only the last page is kept between rows."""
    doc, last = None, None
    for batch in batches:
        found = []
        for d, pages in zip(batch.column("doc_id").to_pylist(), batch.column("pages").to_pylist(), strict=True):
            if d != doc:
                doc, last = d, None
            page = None
            if pages:
                page = next((p for p in pages if last is None or p >= last), pages[0])
                last = page
            found.append(page)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pos"), batch.column("page"), pa.array(found, pa.int64())], ["doc_id", "pos", "page", "found"])


def section_pages(sections: DataFrame, pages_of: DataFrame) -> DataFrame:
    """For each section (doc_id, pos, text, page) the page (doc_id, page, text) of its document that holds its text: sections in
    order, each sought from the last match on and then among the pages before it; else the page it carries, else 1.
    matched tells whether a page holds it.

    A blank section is passed over like one that isn't found. Pages are whole numbers; a null one holds nothing. Pages may have
    several texts. Documents are folded in the order of their rows, in tasks that keep the last page only."""
    s = sections.select("doc_id", "pos", "page", compact(F.col("text")).alias("t"))
    texts = pages_of.where("page is not null").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(compact(F.col("text")))).alias("parts"))
    texts = texts.select("doc_id", F.col("page").alias("text_id"), F.array_join("parts", " ").alias("text"))
    found = contained_in(s.select("doc_id", F.col("pos").alias("needle_id"), F.col("t").alias("needle")), texts)
    pages = found.groupBy("doc_id", F.col("needle_id").alias("pos")).agg(F.sort_array(F.collect_set("text_id")).alias("pages"))
    rows = s.drop("t").withColumn("pos", F.col("pos").cast("long")).join(pages.hint("merge"), ["doc_id", "pos"], "left")
    schema = f"doc_id {s.schema['doc_id'].dataType.simpleString()}, pos long, page {s.schema['page'].dataType.simpleString()}, found long"
    folded = rows.select("doc_id", "pos", "page", "pages").repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(_forward, schema)
    return folded.select("doc_id", F.col("pos").cast(s.schema["pos"].dataType).alias("pos"), F.coalesce("found", "page", F.lit(1)).cast("int").alias("page"), F.col("found").isNotNull().alias("matched"))


#: Notes for pages: issues from severity 2 up at their sections' pages, unverified references at those of their sections or on page 1.
page_notes = SqlOperator(
    "issues places verdicts",
    """select i.doc_id, p.page, 'issue' as kind, cast(greatest(i.severity, 2) as int) as severity, i.rule_id as label, count(*) as n from {issues} i join {places} p on p.doc_id = i.doc_id and p.pos = i.pos group by i.doc_id, p.page, i.severity, i.rule_id
union all select v.doc_id, coalesce(p.page, 1), 'reference', 1, v.verdict, count(*) from {verdicts} v left join {places} p on p.doc_id = v.doc_id and p.pos = v.pos where v.verdict <> 'verified' group by v.doc_id, coalesce(p.page, 1), v.verdict""",
)
