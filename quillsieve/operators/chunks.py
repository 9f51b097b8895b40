"""Overlapping chunks of section texts, chunks of table rows, and code detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sql import SqlOperator
from .lines import code_like, is_code_line


def overlapping_chunks(size: int = 800, overlap: int = 100) -> SqlOperator:
    """Chunk k of a text is the `size` characters from k * (size - overlap) on; an overlap of the size or more counts as none."""
    step = size - overlap if overlap < size else size
    rest = size - step
    return SqlOperator(
        "sections",
        f"""select doc_id, pos, cast(k as int) as k, substring(text, cast(k * {step} + 1 as int), {size}) as chunk from (select doc_id, pos, text, unroll(span(0, cast(greatest(1, ceil((length(text) - {rest}) / real({step}))) as int) - 1)) as k from {{sections}} where text <> '') s""",
    )


def table_row_chunks(rows: DataFrame) -> DataFrame:
    """Rows of tables (doc_id, pos, row_index from 0, cells) -> a chunk for each row: doc_id, table_index (the document's tables counted
    from 1 by their places), row_index from 1, chunk (cells joined by tabs, a null one empty) and cell_count. Null cells give an empty chunk."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    cells = F.coalesce("cells", F.array().cast("array<string>"))
    chunk = F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), "\t")
    tables = rows.select("doc_id", "pos").distinct().withColumn("table_index", F.row_number().over(order))
    out = rows.join(tables.hint("merge"), ["doc_id", "pos"])
    return out.select("doc_id", "table_index", (F.col("row_index") + 1).alias("row_index"), chunk.alias("chunk"), F.size(cells).alias("cell_count"))


def review_groups(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, section_id, pos, text, font) grouped by section id, with the chunks of each and whether all are code: such
    groups need no review. doc_id, section_id, chunks, code_chunks, skipped."""
    rows = sections.select("doc_id", "section_id", code_like(F.col("text"), F.col("font")).alias("code"))
    groups = rows.groupBy("doc_id", "section_id").agg(F.count("*").alias("chunks"), F.count_if("code").alias("code_chunks"))
    return groups.withColumn("skipped", F.col("chunks") == F.col("code_chunks"))


#: Field summary of table sections: fields, required ones, filled and empty required ones.
field_summary = SqlOperator(
    "fields",
    """select doc_id, section_id, count(*) as total_fields, big(sum(case when required then 1 else 0 end)) as required_fields, big(sum(case when required and value <> '' then 1 else 0 end)) as filled_required, big(sum(case when required and value = '' then 1 else 0 end)) as empty_required,
  big(sum(case when value like '%；%' then 1 else 0 end)) as format_errors, coalesce(joined(case when required and value = '' then bare end), '') as critical_gaps from {fields} group by doc_id, section_id""",
)


def code_like_documents(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, pos, line) -> documents that look like code: two code lines or more and 60 % of all, all of them, or a fence."""
    rows = lines.where(F.trim("line") != "").select("doc_id", is_code_line(F.col("line")).alias("code"), F.col("line").contains("```").alias("fence"))
    docs = rows.groupBy("doc_id").agg(F.count_if("code").alias("code_lines"), F.count("*").alias("all_lines"), F.bool_or("fence").alias("fence"))
    code, all_ = F.col("code_lines"), F.col("all_lines")
    return docs.select("doc_id", "code_lines", "all_lines", (F.col("fence") | ((code >= 2) & (code >= 0.6 * all_)) | (code == all_)).alias("code_like"))
