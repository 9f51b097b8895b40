"""From parsed JSON to the canonical tables: sections, references, papers, and columns that rules need in one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The fields of parsed documents.
_SECTION = "id int, section_id int, element_type string, type string, level int, text string, raw_text string, is_table boolean, table_rows array<array<string>>, table_row_positions array<struct<row_index:int,cells:array<string>,page_start:int,page_end:int>>, images array<string>, has_math boolean, formatting struct<font:string,size:string,alignment:string,paragraph_style:string,line_spacing:string>, position struct<section_id:int,paragraph_index:int,page_start:int,page_end:int,xml_path:string>, props map<string,string>"
_REFERENCE = "id string, ref_id string, index int, text string, raw_text string"
_BODY = f"sections array<struct<{', '.join(x.replace(' ', ':', 1) for x in _SECTION.split(', '))}>>, references array<struct<{', '.join(x.replace(' ', ':', 1) for x in _REFERENCE.split(', '))}>>"
PARSED = f"doc_id string, {_BODY}, data struct<{_BODY.replace('sections array', 'sections:array').replace('references array', 'references:array')}>"


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, one JSON object in a line, with a fixed schema; what stands under `data` is taken where the top has none."""
    raw = spark.read.schema(PARSED).json(path)
    return raw.select("doc_id", F.coalesce("sections", "data.sections").alias("sections"), F.coalesce("references", "data.references").alias("references"))


def number_of(text: Column) -> Column:
    """The number in a text like `18pt`, or null."""
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def points_of(half_points: Column) -> Column:
    """A size in half-points as text -> `12pt` or `10.5pt` (one digit, ties to the even one); null if it is no number."""
    points = half_points.try_cast("double") / 2
    return F.when(points == F.floor(points), F.concat(points.cast("bigint").cast("string"), F.lit("pt"))).when(points.isNotNull(), F.concat(F.format_string("%.1f", F.bround(points, 1)), F.lit("pt")))


def sizes_of(rows: DataFrame) -> DataFrame:
    """Rows (id, half) of sizes in half-points as text -> id, half, size and its number of points."""
    return rows.select("id", "half", points_of(F.col("half")).alias("size"), number_of(points_of(F.col("half"))).alias("size_pt"))


def heading_level(style: Column, text: Column) -> Column:
    """1 to 3 by the style's name, else by how the text is numbered, else null."""
    name = F.lower(F.regexp_replace(F.coalesce(style, F.lit("")), r"\s+", ""))
    level = F.lit(None).cast("int")
    # How headings of each level begin, first match first.
    begins = [(1, r"^\s*[1-9]\d*[.．、]\s+"), (2, r"^\s*[1-9]\d*\.[1-9]\d*[.．、]\s+"), (3, r"^\s*[1-9]\d*\.[1-9]\d*\.[1-9]\d*[.．、]\s+"), (1, r"^\s*第[一二三四五六七八九十百千0-9]+[章节篇部分]"), (1, r"^\s*[一二三四五六七八九十]+[、.．]\s*"), (2, r"^\s*[（(][一二三四五六七八九十]+[)）]\s*")]
    for n, pattern in reversed(begins):
        level = F.when(text.rlike(pattern), n).otherwise(level)
    for n in (3, 2, 1):
        level = F.when(name.contains(f"heading{n}") | name.contains(f"标题{n}"), n).otherwise(level)
    return level


def sections_of(parsed: DataFrame) -> DataFrame:
    """One row for each section in order: lower-case type, inferred level, text (raw text first; a table's rows joined by tabs
    and line ends), sizes as numbers, table shape, pages and a map of properties."""
    s = F.col("s")
    rows = parsed.select("doc_id", F.posexplode("sections").alias("pos", "s"))
    grid = F.array_join(F.transform(s.table_rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "\t")), "\n")
    text = F.coalesce(F.nullif(s.raw_text, F.lit("")), F.nullif(s.text, F.lit("")), grid, F.lit(""))
    props = F.map_filter(F.map_concat(F.coalesce(s.props, F.create_map().cast("map<string,string>")), F.create_map(F.lit("font_family"), s.formatting.font, F.lit("alignment"), s.formatting.alignment, F.lit("xml_path"), s.position.xml_path, F.lit("is_table"), s.is_table.cast("string"))), lambda k, v: v.isNotNull() & (v != ""))
    level = heading_level(s.formatting.paragraph_style, text)
    return rows.select(
        "doc_id", "pos", F.coalesce(s.section_id, s.id, s.position.section_id, F.col("pos") + 1).alias("section_id"),
        F.when(s.is_table, "table").when(level.isNotNull(), "heading").otherwise(F.lower(F.trim(F.coalesce(s.type, s.element_type, F.lit("paragraph"))))).alias("type"), F.coalesce(level, s.level, F.lit(0)).alias("level"), text.alias("text"),
        s.formatting.font.alias("font"), number_of(s.formatting.size).alias("size_pt"), F.coalesce(s.has_math, F.lit(False)).alias("has_math"), F.size(F.coalesce(s.table_rows, F.array())).alias("row_count"),
        F.coalesce(F.array_max(F.transform(s.table_rows, lambda r: F.size(r))), F.lit(0)).alias("column_count"), s.position.page_start.alias("page_start"), s.position.page_end.alias("page_end"), props.alias("props"),
    )


def table_rows_of(parsed: DataFrame) -> DataFrame:
    """One row for each row of a table: row_index, cells, pages and whether it runs over a page; rows without a place of their own
    are numbered from 0 and have their section's pages. Unknown pages are null, and such rows run over none."""
    s = F.col("s")
    rows = parsed.select("doc_id", F.posexplode("sections").alias("pos", "s"))
    plain = F.transform(s.table_rows, lambda r, i: F.struct(i.alias("row_index"), r.alias("cells"), s.position.page_start.alias("page_start"), s.position.page_end.alias("page_end")))
    placed = rows.select("doc_id", "pos", F.inline(F.coalesce(F.when(F.size(s.table_row_positions) > 0, s.table_row_positions), plain)))
    return placed.withColumn("is_cross_page", F.coalesce(F.col("page_end") > F.col("page_start"), F.lit(False)))


def references_of(parsed: DataFrame) -> DataFrame:
    """(doc_id, ref_pos, ref_id, raw_text): the id is the first given of ref_id, id, index and the place in the list."""
    r = F.col("r")
    rows = parsed.select("doc_id", F.posexplode("references").alias("at", "r"))
    number = F.coalesce(F.nullif(r.ref_id, F.lit("")), F.nullif(r.id, F.lit("")), r["index"].cast("string"), (F.col("at") + 1).cast("string"))
    return rows.select("doc_id", (F.col("at") + 1).alias("ref_pos"), F.when(number.startswith("["), number).otherwise(F.concat(F.lit("["), number, F.lit("]"))).alias("ref_id"), F.coalesce(r.raw_text, r.text, F.lit("")).alias("raw_text"))


def paper_text(title: Column, authors: Column, journal: Column, year: Column, doi: Column, text: Column, abstract: Column) -> Column:
    """What a paper is found by: its given parts, one in a line."""
    return F.array_join(F.filter(F.array(title, F.array_join(authors, ", "), journal, year.cast("string"), doi, text, abstract), lambda x: x.isNotNull() & (x != "")), "\n")


def upsert_papers(known: DataFrame, new: DataFrame) -> DataFrame:
    """Papers by id, the last write (ingested_at) winning; the id is the given one or the SHA-1 of the document."""
    rows = known.unionByName(new, allowMissingColumns=True).withColumn("paper_id", F.coalesce(F.nullif("paper_id", F.lit("")), F.sha1("document")))
    order = Window.partitionBy("paper_id").orderBy(F.desc("ingested_at"), F.desc("document"))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def save_papers(new: DataFrame, name: str, buckets: int = 64) -> None:
    """Upsert papers into the table `name`, which is bucketed and sorted by paper_id, so that joins on paper_id read it without a shuffle.

    Of each id the last write stays, as in upsert_papers. Papers with ids that are not among the new ones are taken over bucket by
    bucket. The new state is written beside the old one and then takes its name; until then readers have the old one, and a run that
    was lost before leaves it as it was. A table that is there keeps its number of buckets."""
    spark = new.sparkSession
    kept = spark.catalog.tableExists(name)
    rows = upsert_papers(spark.table(name), new) if kept else upsert_papers(new.limit(0), new)
    fresh = f"{name}_next"
    spark.sql(f"drop table if exists {fresh}")
    if kept:
        told = {r.col_name: r.data_type for r in spark.sql(f"describe extended {name}").collect()}
        buckets = int(told.get("Num Buckets", buckets))
    rows.repartition(buckets, "paper_id").write.bucketBy(buckets, "paper_id").sortBy("paper_id").format("parquet").saveAsTable(fresh)
    spark.sql(f"drop table if exists {name}")
    spark.sql(f"alter table {fresh} rename to {name}")


def stored_papers(spark: SparkSession, name: str) -> DataFrame:
    """The papers of a table of save_papers."""
    return spark.table(name)
