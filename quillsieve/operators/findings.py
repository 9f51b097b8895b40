"""Issues of texts as whole rows: message, suggestion, what was found and where, from a catalogue of needles and patterns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .packs import LABEL_HINTS

#: Columns that an issue adds to its row's keys.
ISSUE = ["rule_id", "issue_type", "severity", "message", "suggestion", "original", "start_char", "end_char"]


@dataclass(frozen=True)
class Entry:
    """What raises an issue, and what the issue says.

    `how` is `needle` (a part of the text), `word` (the same in any case), `line` (a pattern somewhere in a line) or `text` (a pattern in
    the text, `also` in it too, and `unless` not in it). A needle or line is told with its first place in the text."""

    rule_id: str
    issue_type: str
    severity: int
    message: str
    suggestion: str
    how: str
    what: str
    also: str | None = None
    unless: str | None = None


# Rule ids, types, severities, needles and patterns with what issues say of them.
_TYPO, _STYLE = "疑似错别字或重复标点", "口语化或情绪化表述"
_NO_BRACKET, _TWO_BRACKETS = r"(?<!\[)[A-Z]\]\.", r"\[\[[A-Z]\]\."
CATALOGUE = [
    Entry("TYPO-001", "typo", 3, _TYPO, "图像分类中", "needle", "图像分类种"),
    Entry("TYPO-001", "typo", 3, _TYPO, "的", "needle", "的的"),
    Entry("TYPO-001", "typo", 3, _TYPO, "，", "needle", "，，"),
    Entry("TYPO-001", "typo", 3, _TYPO, "。", "needle", "。。"),
    Entry("FORMAT-004", "format", 2, "摘要标题后缺少空格", "改为 Abstract: ", "line", r"(?i)^Abstract:[^\s]"),
    Entry("FORMAT-006", "format", 2, "关键词标题后缺少空格", "改为 Keywords: ", "line", r"(?i)^Keywords:[^\s]"),
    Entry("FORMAT-005", "format", 2, "英文关键词分隔不规范", "关键词之间统一使用“; ”分隔", "line", r"(?i)^Keywords:\s*.*;\S"),
    Entry("FORMAT-001", "format", 2, "中英文标点可能混用", "统一为中文学术写作标点", "text", r"[A-Za-z]+[，。；：、]", unless="|".join(LABEL_HINTS)),
    Entry("FORMAT-002", "format", 2, "英文图表缩写出现在正文中", "统一中文图表编号格式", "text", r"Fig\.|Table|Eq\."),
    Entry("STYLE-001", "logic", 2, _STYLE, "表现出显著优势", "word", "非常好"),
    Entry("STYLE-001", "logic", 2, _STYLE, "结果表明", "word", "很开心"),
    Entry("STYLE-001", "logic", 2, _STYLE, "表现良好", "word", "挺好的"),
    Entry("STYLE-001", "logic", 2, _STYLE, "已有研究表明", "word", "听说"),
    Entry("STYLE-001", "logic", 2, _STYLE, "本质上", "word", "basically"),
    Entry("REF-002", "reference", 3, "参考文献类型标记缺少左括号", "补全为 [D]. / [J]. / [C].", "line", _NO_BRACKET),
    Entry("REF-003", "reference", 3, "参考文献类型标记括号重复", "删除多余的左括号", "line", _TWO_BRACKETS),
    Entry("REF-001", "reference", 3, "参考文献格式可能不完整", "补全作者、年份、题名、期刊和页码", "text", r"\[\d+\]\s*[^\n]+|\b\d{4}\b", also="参考文献", unless=r"\[[0-9]+\].+\d{4}"),
    Entry("REF-004", "reference", 3, "参考文献类型标记格式异常", "统一使用 [D]、[J]、[C] 等规范格式", "text", r"\[[0-9]+\][^\n]*[A-Za-z].*?\d{4}", also=f"{_NO_BRACKET}|{_TWO_BRACKETS}"),
]


class Matcher:
    """All needles of a catalogue in one automaton, its patterns compiled once."""

    def __init__(self, entries: list[Entry]):
        self.entries = entries
        self.exact, self.lower = (self._automaton(how) for how in ("needle", "word"))
        self.lines = [(k, re.compile(e.what)) for k, e in enumerate(entries) if e.how == "line"]
        self.texts = [(k, *(re.compile(p) if p else None for p in (e.what, e.also, e.unless))) for k, e in enumerate(entries) if e.how == "text"]

    def _automaton(self, how: str):
        automaton = ahocorasick.Automaton()
        for k, e in enumerate(self.entries):
            if e.how == how and e.what:
                word = e.what.lower() if how == "word" else e.what
                automaton.get(word).append(k) if word in automaton else automaton.add_word(word, [k])
        if len(automaton):
            automaton.make_automaton()
        return automaton

    @staticmethod
    def _place(text: str, needle: str) -> tuple[int, int]:
        at = text.find(needle)
        return (0, min(len(text), len(needle))) if at < 0 else (at, at + len(needle))

    def find(self, text: str) -> Iterator[tuple[int, str | None, int | None, int | None]]:
        """(entry, original, start, end) of all issues, in no order that matters."""
        for automaton, read in ((self.exact, text), (self.lower, text.lower())):
            seen: set[int] = set()
            for _, found in automaton.iter(read) if len(automaton) else ():
                seen.update(found)
            for k in seen:
                yield k, self.entries[k].what, *self._place(text, self.entries[k].what)
        if self.lines:
            for line in filter(None, map(str.strip, text.splitlines())):
                for k, pattern in self.lines:
                    if pattern.search(line):
                        yield k, line, *self._place(text, line)
        for k, what, also, unless in self.texts:
            if what.search(text) and (also is None or also.search(text)) and not (unless and unless.search(text)):
                yield k, None, None, None


def _rows(entries: list[Entry], keys: list[str]) -> Callable:
    def rows(batches) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for hit in matcher.find(text) if text else ():
                    at.append(i)
                    found.append(hit)
            of = [entries[k] for k, *_ in found]
            told = {
                "rule_id": [e.rule_id for e in of], "issue_type": [e.issue_type for e in of], "severity": [min(5, max(1, e.severity)) for e in of], "message": [e.message for e in of],
                "suggestion": [e.suggestion or None for e in of], "original": [f[1] or None for f in found], "start_char": [f[2] for f in found], "end_char": [f[3] for f in found],
            }
            kinds = {c: pa.int32() if c in ("severity", "start_char", "end_char") else pa.string() for c in told}
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in keys], *[pa.array(v, kinds[c]) for c, v in told.items()]], [*keys, *told])

    return rows


def text_issues(texts: DataFrame, keys: list[str], catalogue: Iterable[Entry] = CATALOGUE, areas: tuple[str, ...] | None = None) -> DataFrame:
    """Issues of texts (keys and text): the keys, rule_id, issue_type, severity (1 to 5), message, suggestion, original, start_char and
    end_char, in characters. One pass over each text, whatever the number of needles.

    A needle raises one issue for a text, at its first place (0 to the smaller length where only another case of it is there); a line
    pattern one for each line that has it, at the line's first place; a text pattern one without a place. areas: the issue types
    that are asked for, all by default; others are not compiled. A catalogue of one's own, or CATALOGUE and more, can be given. Null and
    empty texts have no issues; other columns are left out."""
    entries = [e for e in catalogue if areas is None or e.issue_type in areas]
    fields = [f for k in keys for f in texts.schema.fields if f.name == k]
    kinds = [StructField(c, IntegerType() if c in ("severity", "start_char", "end_char") else StringType()) for c in ISSUE]
    return texts.select(*keys, "text").mapInArrow(_rows(entries, keys), StructType([*fields, *kinds]))
