"""Which texts of a document contain which of its needles, by one pass of a multi-pattern automaton over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a document that one row brings to a task, and needles that one automaton has.
_TEXTS, _NEEDLES = 64, 4096
_OUT = "doc_id long, needle_id long, text_id long"


def _found(needles: list[tuple[int, str]], texts: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
    """(needle_id, text_id), once each."""
    automaton = ahocorasick.Automaton()
    for i, s in needles:
        automaton.get(s).append(i) if s in automaton else automaton.add_word(s, [i])
    automaton.make_automaton()
    for t, text in texts:
        seen: dict[int, None] = {}
        for _, ids in automaton.iter(text):
            if ids[0] not in seen:
                seen.update(dict.fromkeys(ids))
        for i in seen:
            yield i, t


def _scan(batches):
    for batch in batches:
        for r in batch.to_pylist():
            pairs = list(_found([(n["needle_id"], n["needle"]) for n in r["needles"]], [(t["text_id"], t["text"]) for t in r["texts"]]))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"]] * len(pairs), pa.int64()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["doc_id", "needle_id", "text_id"])


def _blocks(df: DataFrame, number: str, size: int, text: str, name: str) -> DataFrame:
    """Rows of a document in blocks of at most about `size`, dealt by a hash of their number, one array each."""
    many = df.groupBy("doc_id").agg(F.count("*").alias("many"))
    rows = df.join(many.hint("merge"), "doc_id").withColumn("block", F.pmod(F.xxhash64(number), F.greatest(F.ceil(F.col("many") / size), F.lit(1))))
    return rows.groupBy("doc_id", "block").agg(F.collect_list(F.struct(number, text)).alias(name)).drop("block")


def contained_in(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needles (doc_id, needle_id, needle), texts (doc_id, text_id, text) -> (doc_id, needle_id, text_id) for each needle that is a
    part of a text of its document.

    An automaton of a document's needles reads each text once, instead of a test of each needle on each text. Documents are cut
    into blocks of 64 texts and 4,096 needles, so that a large one is no single task. Ids are whole numbers, unique in their
    document; empty and null needles, null texts and null documents have none; an empty table gives an empty one."""
    named = needles.where("doc_id is not null and needle <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("needle_id").cast("long").alias("needle_id"), "needle")
    read = texts.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text_id").cast("long").alias("text_id"), "text")
    pairs = _blocks(read, "text_id", _TEXTS, "text", "texts").join(_blocks(named, "needle_id", _NEEDLES, "needle", "needles").hint("merge"), "doc_id")
    return pairs.select("doc_id", "needles", "texts").mapInArrow(_scan, _OUT)
