"""Checks of lines and places in texts, and small conversions, as DataFrame code (the oracle's SQL is written apart)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fonts of code, how code lines begin and what stands in them, and what references look like.
CODE_FONTS = ["consolas", "courier", "monaco", "fira code", "lucida console"]
#: What words are made of, in any script, and their edges. Both are written out: what `\b` takes for a word differs between versions of Java and in the
#: oracle's engine. Letters of code are spelled in both cases for the same reason.
_W = r"\p{L}\p{N}_"
_BEFORE, _AFTER = rf"(?:^|[^{_W}])", rf"(?:$|[^{_W}])"
_SPACE = r"[\x09-\x0D\x20]"


def _words(words: str) -> str:
    return "(?:" + "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in words.split()) + ")"


CODE_LINE = rf"(?s)^(?:{_SPACE}*(?:```|//|/\*|\*|#|///)|{_SPACE}*{_words('using import from public private protected class def void int float double string bool namespace')}{_AFTER}|.*[{{}};].*)"
CODE_WORD = _BEFORE + _words("using import class def return void public private protected namespace") + _AFTER
CODE_COMMENTS = ["///", "#"]
CODE_CALL = rf"{_BEFORE}[A-Za-z_][A-Za-z0-9_.]*{_SPACE}*\("
CHINESE = r"[一-鿿]"
REFERENCE_LINE = rf"^(?:\[[0-9]+\]|参考文献{_AFTER}|[0-9]+\.|\[[A-Z]\])"
REFERENCE_CONTENT = rf"(?i)(?:\[[JMDCP]\]|{_BEFORE}(?:doi{_AFTER}|et al\.[{_W}]|[0-9]{{4}}{_AFTER}))"
ABBREVIATION = r"(?<![A-Za-z0-9])(?:[A-Z]{2,}[A-Za-z0-9]*|[A-Z][a-z]+[A-Z][A-Za-z0-9]*)(?![A-Za-z0-9])"
DEFINED_AFTER = r"([一-鿿][^\n（）()]{1,40}?)\s*[（(]\s*([A-Z]{2,}[A-Za-z0-9]*)\s*[)）]"
DEFINED_BEFORE = r"([A-Z]{2,}[A-Za-z0-9]*)\s*[（(]\s*([^\n（）()]{2,40})\s*[)）]"


def is_code_line(line: Column) -> Column:
    """A line that begins or ends like code, or, without a Chinese character, has a mark, word or call of code in it."""
    plain = ~line.rlike(CHINESE)
    return line.rlike(CODE_LINE) | (plain & (line.contains("#") | line.rlike(CODE_WORD) | line.contains(";") | line.rlike(CODE_CALL)))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, rf"^{_SPACE}+|{_SPACE}+$", "")), lambda x: x != "")


def _comment(line: Column) -> Column:
    return line.startswith(CODE_COMMENTS[0]) | line.startswith(CODE_COMMENTS[1])


def without_comment(line: Column) -> Column:
    """A line without a comment that follows code in it; nothing of a line that is a comment."""
    out = line
    for mark in reversed(CODE_COMMENTS):
        before = F.rtrim(F.substring_index(line, mark, 1))
        code = before.rlike(CODE_LINE) | before.rlike(CODE_WORD) | before.rlike(CODE_CALL)
        out = F.when((F.instr(line, mark) > 1) & code, before).otherwise(out)
    return F.when(_comment(line), "").otherwise(out)


def code_like(text: Column, font: Column) -> Column:
    """Whether a section is code: by a font of code, a fence, or its lines: two code lines or more that are 60 % of all, a
    single line that is a comment, or one of code without a Chinese character outside its comment. A null or blank text is
    none; a null font says nothing."""
    lines = _lines(text)
    code, all_ = F.size(F.filter(lines, lambda x: _comment(x) | is_code_line(without_comment(x)))), F.size(lines)
    name, only = F.lower(F.coalesce(font, F.lit(""))), F.get(lines, F.lit(0))
    by_font = F.lit(False)
    for marker in CODE_FONTS:
        by_font |= name.contains(marker)
    by_lines = ((code >= 2) & (code >= 0.6 * all_)) | ((all_ == 1) & (_comment(only) | ((code == 1) & ~without_comment(only).rlike(CHINESE))))
    return by_font | ((all_ > 0) & (F.coalesce(text, F.lit("")).contains("```") | by_lines))


def code_sections(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, pos, text, font) with their code flag; one pass."""
    return sections.select("doc_id", "pos", code_like(F.col("text"), F.col("font")).alias("is_code"))


def prose(sections: DataFrame) -> DataFrame:
    """Sections that are not code, for the rules that pass code over; all columns."""
    return sections.where(~code_like(F.col("text"), F.col("font")))


def audit_lines(sections: DataFrame) -> DataFrame:
    """Lines (doc_id, pos, n, line) of sections that are neither blank nor like references or code, numbered in their section."""
    rows = sections.select("doc_id", "pos", F.posexplode(_lines(F.col("text"))).alias("n", "line"))
    return rows.where(~(F.col("line").rlike(REFERENCE_LINE) | F.col("line").rlike(REFERENCE_CONTENT) | is_code_line(F.col("line"))))


def undefined_abbreviations(lines: DataFrame) -> DataFrame:
    """One row for each abbreviation that a document with Chinese text uses without a Chinese full form, over audit_lines().

    Definitions are `全称（ABC）` and `ABC（全称）`, whose full form has a Chinese character. Sets of a document are merged before
    the shuffle; a document without Chinese text has none."""
    line = F.col("line")
    used = F.transform(F.regexp_extract_all(line, F.lit(ABBREVIATION), F.lit(0)), F.upper)
    after = F.regexp_extract_all(line, F.lit(DEFINED_AFTER), F.lit(2))
    pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(DEFINED_BEFORE), F.lit(1)).alias("a"), F.regexp_extract_all(line, F.lit(DEFINED_BEFORE), F.lit(2)).alias("f"))
    before = F.transform(F.filter(pairs, lambda p: p.f.rlike(CHINESE)), lambda p: p.a)
    rows = lines.select("doc_id", used.alias("used"), F.transform(F.concat(after, before), F.upper).alias("defined"), line.rlike(CHINESE).alias("chinese"))
    sets = rows.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("used"))).alias("used"), F.array_distinct(F.flatten(F.collect_list("defined"))).alias("defined"), F.bool_or("chinese").alias("chinese"))
    left = sets.where("chinese").select("doc_id", F.explode(F.array_except("used", "defined")).alias("abbreviation"))
    return left.where(F.length("abbreviation") >= 2).select("doc_id", "abbreviation", F.lit("CONSIST-003").alias("rule_id"), F.lit(1).alias("severity"))


def needle_positions(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, text, needle) -> start_char and end_char of the needle's first place; where it isn't, from 0 to the
    smaller length; 0 and 0 for a null or empty text or needle. Characters are code points."""
    at, n = F.expr("instr(text, needle)"), F.length("needle")
    some = (F.coalesce(F.length("text"), F.lit(0)) > 0) & (F.coalesce(n, F.lit(0)) > 0)
    start = F.when(some & (at > 0), at - 1).otherwise(0)
    end = F.when(some, F.when(at > 0, at - 1 + n).otherwise(F.least(F.length("text"), n))).otherwise(0)
    return rows.select("doc_id", "pos", start.alias("start_char"), end.alias("end_char"))


def utc8(text: Column) -> Column:
    """An ISO time as text, taken as UTC if it names no zone, as `yyyy-mm-dd hh:mm:ss+08:00`; null if it is no time."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    at = F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("+08:00"), at.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss'+08:00'")


def iso_date(text: Column) -> Column:
    """The ISO form of a date like `2024年1月5日`, the whole text; null if it is none or no such day exists."""
    part = lambda k: F.regexp_extract(text, r"^(\d{4})年(\d{1,2})月(\d{1,2})日$", k)
    whole = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.date_format(F.when(part(1) != "", whole).try_cast("date"), "yyyy-MM-dd")


def date_fixes(cells: DataFrame) -> DataFrame:
    """Cells with a date in another form, and what to write instead: doc_id, row_index, col, value, fixed (null where no day is meant)."""
    return cells.where(F.col("value").rlike(r"^\d{4}年\d{1,2}月\d{1,2}日$")).select("doc_id", "row_index", "col", "value", iso_date(F.col("value")).alias("fixed"))


def sentinel_counts(rows: DataFrame, key: str, sentinel: str = "unknown") -> DataFrame:
    """How often the sentinel is a value, at any depth, in the rows of each key: rows may nest arrays, maps and structs.

    Counted in the rows' JSON, in which quotes inside a text are escaped, so that no text can look like a value."""
    text = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != key]))
    count = F.regexp_count(text, F.lit(r'(?<=[:\[,])"' + sentinel + r'"(?=[,\]}])'))
    return rows.groupBy(key).agg(F.sum(count).alias("n"))


def footer_issues(footers: DataFrame) -> DataFrame:
    """Sections (doc_id, section, footer XML) whose footer is missing, has no PAGE field, or isn't centred: PAGE-001 once each."""
    xml = F.col("footer")
    centred = xml.contains('w:jc w:val="center"') | xml.contains("w:jc w:val='center'")
    bad = xml.isNull() | ~F.upper(xml).contains("PAGE") | ~centred
    return footers.where(bad).select("doc_id", "section", F.lit("PAGE-001").alias("rule_id"), F.lit(2).alias("severity"))


def section_groups(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, section_id, pos, k) of each section, the sections numbered as they are first seen, with the chunks' order."""
    from pyspark.sql import Window

    rows = chunks.groupBy("doc_id", "section_id").agg(F.min(F.struct("pos", "k")).alias("first"), F.count("*").alias("chunks"), F.sort_array(F.collect_list(F.struct("pos", "k"))).alias("members"))
    order = Window.partitionBy("doc_id").orderBy("first", "section_id")
    listed = F.array_join(F.transform("members", lambda m: F.concat_ws(".", m.pos.cast("string"), m.k.cast("string"))), ",")
    return rows.select("doc_id", "section_id", F.row_number().over(order).alias("place"), "chunks", listed.alias("members"))
