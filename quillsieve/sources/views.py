"""Audit tables derived from the given tables: sections, references, citations, documents, cells, styles, papers, tasks.

Each view is one SQL text for Spark and for the oracle; defects come in by remainders of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.sql import duck_sql, spark_sql

_LINES = ("select doc_id, pos, line0 from {documents} lateral view posexplode(split(text, '\\n')) t as pos, line0", "select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as line0 from {documents}")

VIEWS: dict[str, tuple[list[str], str]] = {
    "sections": (
        ["documents"],
        """select doc_id, pos, pos + 1 as section_id,
  case when length(line) < 40 then 'heading' when pos % 11 = 7 then 'table' when pos % 11 = 5 then 'figure' else 'paragraph' end as type,
  case when length(line) < 40 then 1 + length(line) % 4 else 0 end as level, line as text, cast(10 + pos % 10 as double) as size_pt,
  case (doc_id + pos) % 4 when 0 then 'SimHei' when 1 then 'SimSun' when 2 then 'Arial' else null end as font,
  cast(4 + (doc_id + pos) % 3 as double) / 4 as line_spacing, cast((doc_id + pos) % 3 as double) as first_line_indent
from (select doc_id, pos, trim(line0) as line from (LINES) l) x where line <> ''""",
    ),
    "refs": (
        ["lineitem", "part"],
        """with r as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as ref_pos, l_partkey, l_suppkey from {lineitem})
select doc_id, ref_pos, concat('[', cast(ref_pos as varchar(9)), ']') as ref_id,
  concat('[', cast(ref_pos as varchar(9)), '] ', case l_suppkey % 5 when 0 then 'ZHANG S, LI W, WANG Q, ZHAO L' when 1 then 'ZHANG S，LI W' when 2 then 'smith j' when 3 then 'LIU Y' else 'WU K；SUN L; QIAN M' end, '. ', p_name,
    case l_partkey % 4 when 0 then '[J]' when 1 then '[M]' when 2 then '[D]' else '[C]' end, case when l_suppkey % 7 = 0 then ' ' else '. ' end, p_brand, ', ', cast(1880 + l_partkey % 160 as varchar(9)), case l_partkey % 9 when 0 then ', 2030' when 4 then ', 1203-1210' else '' end,
    case when l_suppkey % 3 = 0 then ', 35(6)' else '' end, case when l_suppkey % 4 = 0 then ': 18-21.' else '.' end) as raw_text
from r join {part} on l_partkey = p_partkey""",
    ),
    "cites": (
        ["lineitem"],
        """select doc_id, pos, case k % 4 when 0 then concat('see [', n, ']') when 1 then concat('seen [', n, '-', m, '] there') when 2 then concat('as [', n, ',', m, '] and [', m, ']')
  else case k % 32 when 3 then concat('in [', n, ',', m, ',', o, ']') when 7 then concat('in [', n, ' ', m, ' ', o, ']') when 11 then concat('in [', n, ',', m, '-', o, ']') when 15 then concat('at [ ', n, ' ]') when 19 then concat('in [', o, ', ', n, ' - ', m, ']') else 'no citation' end end as text
from (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as pos, l_partkey as k,
  cast(l_linenumber + l_partkey % 3 as varchar(9)) as n, cast(l_linenumber + l_partkey % 3 + 1 + l_partkey % 2 as varchar(9)) as m,
  cast(l_linenumber + l_partkey % 3 + 4 as varchar(9)) as o from {lineitem}) x""",
    ),
    "docs": (
        ["orders"],
        """select o_orderkey as doc_id, case o_orderkey % 5 when 0 then 'A thesis on rules' when 1 then 'Journal of checks' when 2 then 'Conference proceedings' when 3 then 'A book' else case when o_orderkey % 2 = 0 then ' ' else '' end end as title,
  cast(o_custkey % 70 as int) as page_count, cast(20 + o_orderkey % 12 as double) / 10 as margin_top, cast(20 + o_custkey % 14 as double) / 10 as margin_bottom, cast(21 + o_custkey % 9 as double) / 10 as margin_left, cast(20 + o_orderkey % 10 as double) / 10 as margin_right from {orders}""",
    ),
    "cells": (
        ["customer"],
        """select c_custkey as doc_id, 1 as section_id, 1 as table_index, cast(c_custkey % 7 as int) as row_index, i as col, concat(n, case when (c_custkey + i) % 3 = 0 then '*' else '' end) as name,
  case (c_custkey * 3 + i) % 7 when 0 then '' when 1 then n when 2 then '2024年1月5日' when 3 then '四年' when 4 then 'a；b' when 5 then '公开' else 'x' end as value
from (select c_custkey, i, case i when 1 then '密级' when 3 then '学位级别' else '学制' end as n from {customer}, (values (1), (3), (5)) v(i)) x""",
    ),
    "styles": (
        ["nation", "region"],
        """select n_regionkey as doc_id, concat('n', cast(n_nationkey as varchar(9))) as style_id, concat('r', cast(n_regionkey as varchar(9))) as parent, case when n_nationkey % 2 = 0 then 'SimSun' end as font, case when n_nationkey % 3 = 0 then real(n_nationkey) end as size_pt from {nation}
union all select r_regionkey, concat('r', cast(r_regionkey as varchar(9))), 'base', case when r_regionkey % 2 = 0 then 'Arial' end, case when r_regionkey % 3 = 1 then 12.0e0 end from {region}
union all select r_regionkey, 'base', cast(null as varchar(9)), 'SimHei', 10.5e0 from {region}""",
    ),
    "papers": (
        ["benchmark"],
        """select item_id as paper_id, array_join_first_six as title, concat('Author ', cast(item_id % 7 as varchar(9))) as authors, 1990 + item_id % 30 as year,
  concat('Journal ', cast(item_id % 5 as varchar(9))) as journal, concat('10.1/', cast(item_id as varchar(9))) as doi, text as document from (select item_id, text, FIRST6 as array_join_first_six from {benchmark}) x""",
    ),
    "tasks": (
        ["events"],
        """select user_id as id, event_id, ts as updated_at, event_type as current_stage, value as progress, length(props) as size from {events}""",
    ),
}
_FIRST6 = ("array_join(slice(split(text, ' '), 1, 6), ' ')", "array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ')")


def _text(name: str, dialect: int) -> str:
    return VIEWS[name][1].replace("LINES", _LINES[dialect]).replace("FIRST6", _FIRST6[dialect])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = VIEWS[name][0]
    sql = spark_sql(_text(name, 0))
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def view_sql(name: str) -> str:
    """The view for the oracle."""
    sql = duck_sql(_text(name, 1))
    for t in VIEWS[name][0]:
        sql = sql.replace("{" + t + "}", t)
    return sql
