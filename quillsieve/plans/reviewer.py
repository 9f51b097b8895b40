"""A reviewer from outside (a model, a service, another program) as a step of Spark: batched calls, checked answers, contained failures."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.issues import relocated_spans

#: Called with some chunks (doc_id, pos, text) at once; gives for each a list of issues, dictionaries with any of FIELDS.
Reviewer = Callable[[list[dict]], list[list[dict]]]

# What an issue of a reviewer may have, and of what kind it must be.
FIELDS = {"rule_id": str, "issue_type": str, "severity": int, "message": str, "suggestion": str, "original": str, "start_char": int, "end_char": int}
_KINDS = {str: pa.string(), int: pa.int32()}
_SCHEMA = "doc_id long, pos int, rule_id string, issue_type string, severity int, message string, suggestion string, original string, start_char int, end_char int"
_log = logging.getLogger(__name__)


def _checked(issue: object) -> dict | None:
    """An issue with all fields, severity within 1 to 5; None if a value is of a wrong kind, or if it says neither rule nor message."""
    if not isinstance(issue, dict) or not (issue.get("rule_id") or issue.get("message")):
        return None
    out = {}
    for name, kind in FIELDS.items():
        value = issue.get(name)
        if value is not None and (not isinstance(value, kind) or isinstance(value, bool)):
            return None
        out[name] = value
    out["severity"] = min(5, max(1, out["severity"] or 1))
    return out


def _answers(call: Reviewer, chunks: list[dict]) -> list[list[dict]]:
    """The checked issues of each chunk. If a call fails, its chunks are asked one by one, and one that fails by itself has none."""
    try:
        found = call(chunks)
        if not isinstance(found, list) or len(found) != len(chunks):
            raise ValueError(f"{len(chunks)} chunks, another number of answers")
    except Exception as error:
        if len(chunks) == 1:
            _log.warning("no review of document %s at %s: %s", chunks[0]["doc_id"], chunks[0]["pos"], error)
            return [[]]
        return [_answers(call, [c])[0] for c in chunks]
    return [[y for y in map(_checked, x) if y] if isinstance(x, list) else [] for x in found]


def outside_issues(sections: DataFrame, call: Reviewer, size: int = 16) -> DataFrame:
    """Issues that a reviewer has of sections (doc_id, pos, text): doc_id, pos and FIELDS.

    The reviewer runs in the tasks, with up to `size` sections at once. What it gives is checked one by one: a wrong issue is left out,
    and a failure costs the issues of the section that caused it and no others. An `original` is looked for in the
    text near the span that was given for it; one that isn't there keeps its words and has no span. Sections without text
    aren't asked about; repeated rows each are."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                chunks = batch.slice(at, size).to_pylist()
                found = [(c, i) for c, issues in zip(chunks, _answers(call, chunks), strict=True) for i in issues]
                columns = {"doc_id": pa.array([c["doc_id"] for c, _ in found], pa.int64()), "pos": pa.array([c["pos"] for c, _ in found], pa.int32()), "text": pa.array([c["text"] for c, _ in found], pa.string())}
                columns |= {k: pa.array([i[k] for _, i in found], _KINDS[kind]) for k, kind in FIELDS.items()}
                yield pa.RecordBatch.from_pydict(columns)

    asked = sections.where(F.col("text") != "").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("pos").cast("int").alias("pos"), "text")
    found = asked.mapInArrow(rows, _SCHEMA.replace("pos int,", "pos int, text string,"))
    placed = relocated_spans(found)
    named = F.coalesce(F.length("original"), F.lit(0)) > 0
    span = lambda c: F.when(named, F.col(f"new_{c}")).otherwise(F.col(f"{c}_char")).cast("int").alias(f"{c}_char")
    return placed.select("doc_id", "pos", "rule_id", "issue_type", "severity", "message", "suggestion", "original", span("start"), span("end"))


def outside_reviewer(call: Reviewer, size: int = 16) -> Callable[[DataFrame], DataFrame]:
    """The reviewer that plans.audit.review() takes."""
    return lambda sections: outside_issues(sections, call, size)
