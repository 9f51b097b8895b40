"""SQL that both Spark and the test oracle can run: a few spellings differ and are filled in here.

`rx(a, «pattern»)` is a regular-expression test, `«...»` a string without escapes, ⟦ and ⟧ the edges of a run of
ASCII letters and digits in a pattern, `joined(x)` the sorted distinct values
of a group joined by commas, `items(a)` the size of an array, `num(x)` a number or null, `big(x)` a 64-bit whole number,
`real(x)` a double, `code(x)` the character of a code point, `unroll(a)` a row for each item, `span(a, b)` whole
numbers from a to b, `many(a, b)` an array, `common(a, b))` the size of an intersection,
`uniq(a)` distinct items, `lowest(a)` and `highest(a)` the least and largest item, `leading(a, n)` the first n items, `hex8(x)` the first 32 bits of a SHA-256 digest, `nth(a, i)`
an item from 0.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SPARK = [
    (r", 'g'\)", ")"),
    (r"\brx\(", "regexp_like("), ("«", "r'"), ("»", "'"), ("⟦", "(?<![A-Za-z0-9])"), ("⟧", "(?![A-Za-z0-9])"), (r"\bjoined\(([^()]*(?:\([^()]*\))?[^()]*)\)", r"array_join(array_sort(collect_set(cast(\1 as string))), ',')"),
    (r"\bitems\(", "size("), (r"\bnum\(([^()]*(?:\([^()]*\))?[^()]*)\)", r"try_cast(\1 as double)"), (r"\bbig\(", "bigint("), (r"\breal\(", "double("), (r"\bcode\(", "char("), (r"\bbytes\(", "octet_length("), (r"\btext\[\]", "array<string>"), (r"\bint\[\]", "array<int>"), (r"\blowest\(", "array_min("), (r"\bleading\(([a-z]+), ", r"slice(\1, 1, "), (r"\bhighest\(", "array_max("), (r"\bunroll\(", "explode("), (r"\bspan\(", "sequence("), (r"\bmany\(", "array("), (r"\bcommon\(", "size(array_intersect("), (r"\buniq\(", "array_distinct("), (r"\bhex8\(([a-z_]+)\)", r"bigint(conv(substring(sha2(\1, 256), 1, 8), 16, 10))"), (r"\bnth\(", "get("),
]
_DUCK = [
    (r"\brx\(", "regexp_matches("), ("«", "'"), ("»", "'"), ("⟦|⟧", r"\\b"), (r"\bjoined\(([^()]*(?:\([^()]*\))?[^()]*)\)", r"array_to_string(list_sort(list(distinct cast(\1 as varchar))), ',')"),
    (r"\bitems\(", "len("), (r"\bnum\(([^()]*(?:\([^()]*\))?[^()]*)\)", r"try_cast(\1 as double)"), (r"\bcode\(", "chr("), (r"\bbytes\(", "strlen("), (r"\blast_value_known\(([a-z_]+)\)", r"last_value(\1 ignore nulls)"),
    (r"\bcollect_list\(", "list("), (r"\bcast\(([^()]*(?:\([^()]*\))?[^()]*) as string\)", r"cast(\1 as varchar)"), (r"\bbool_or\(", "bool_or("), (r"\blowest\(", "list_min("), (r"\bleading\(([a-z]+), ", r"list_slice(\1, 1, "), (r"\bhighest\(", "list_max("), (r"\bunroll\(", "unnest("), (r"\bspan\(", "generate_series("), (r"\bmany\(", "list_value("), (r"\bcommon\(", "len(list_intersect("), (r"\buniq\(", "list_distinct("), (r"\bhex8\(([a-z_]+)\)", r"('0x' || substr(sha256(\1), 1, 8))::bigint"), (r"\bnth\(([a-z_]+), ([a-z0-9_+ ]+)\)", r"\1[\2 + 1]"),
]


def _spell(sql: str, table: list[tuple[str, str]]) -> str:
    for a, b in table:
        sql = re.sub(a, b, sql)
    return sql


def spark_sql(sql: str) -> str:
    return _spell(re.sub(r"\blast_value_known\(([a-z_]+)\)", r"last_value(\1, true)", sql), _SPARK)


def duck_sql(sql: str) -> str:
    for name, kind in (("big", "bigint"), ("real", "double")):
        while m := re.search(rf"\b{name}\(", sql):
            depth, end = 1, m.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = f"{sql[: m.start()]}cast({sql[m.end() : end - 1]} as {kind}){sql[end:]}"
    return _spell(sql, _DUCK)


def run(sql: str, spark: SparkSession | None = None, **frames: DataFrame) -> DataFrame:
    """Run SQL over data frames, which it names in braces."""
    spark = spark or next(iter(frames.values())).sparkSession
    in_patterns = re.sub("«[^»]*»", lambda m: m[0].replace("{", "{{").replace("}", "}}"), sql)
    return spark.sql(spark_sql(in_patterns), **frames)


class SqlOperator:
    """An operator over named data frames, given as SQL: call it with the frames in the order of `inputs`.

    Frames that the SQL joins get a hint for sort-merge joins: they come from explodes and generators, whose sizes Spark can't
    estimate well enough to broadcast them."""

    def __init__(self, inputs: str, sql: str, doc: str = ""):
        self.inputs, self.sql, self.__doc__ = inputs.split(), sql, doc

    def __call__(self, *frames: DataFrame) -> DataFrame:
        joins = " join " in self.sql or "exists (" in self.sql
        return run(self.sql, **{k: f.hint("merge") if joins else f for k, f in zip(self.inputs, frames, strict=True)})

    def oracle(self, sources: dict[str, str], names: list[str]) -> str:
        """For the oracle; sources: SQL of what is read, names: which of it stands for each input."""
        text = duck_sql(self.sql)
        for name, at in zip(self.inputs, names, strict=True):
            text = text.replace("{" + name + "}", at)
        given = ", ".join(f"{k} as ({v})" for k, v in sources.items())
        if not given:
            return text
        lead = text.lstrip()
        if lead.lower().startswith("with recursive "):
            return f"with recursive {given}, {lead[15:]}"
        return f"with {given}, {lead[5:]}" if lead.lower().startswith("with ") else f"with {given} {text}"
