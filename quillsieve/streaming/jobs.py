"""Structured Streaming jobs: incremental audits and task progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.audit import Pack, audit
from .status import final_status

#: What a table of issues has: doc_id, pos, pack, rule_id and severity of audit(), and the batch.
_ISSUES = "doc_id long, pos int, pack string, rule_id string, severity int, batch long"


def incremental_audit(
    documents: DataFrame, tables_of: Callable[[DataFrame], dict[str, DataFrame]], target: str, checkpoint: str, more: dict[str, Pack] | None = None
) -> StreamingQuery:
    """Audit documents as they arrive: tables_of makes the tables of a batch (sections, refs and what packs of one's own need).

    A document arrives whole, so that all packs, those over its sections in order too, run within a batch. Each batch writes its
    issues and the ids of its documents to folders of its own, which a repeated batch overwrites. A document that arrives again
    replaces what was known of it: current_issues() takes of each document the last batch only."""

    def batch(df: DataFrame, number: int) -> None:
        audit(tables_of(df), more=more).write.mode("overwrite").parquet(f"{target}/issues/batch={number}")
        df.select("doc_id").where("doc_id is not null").distinct().write.mode("overwrite").parquet(f"{target}/documents/batch={number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_issues(spark: SparkSession, target: str, ids: str = "long") -> DataFrame:
    """Issues of all documents that incremental_audit has written to target, each document's from its last arrival; documents
    whose last arrival raised none have none. ids: the type of doc_id."""
    last = spark.read.schema(f"doc_id {ids}, batch long").parquet(f"{target}/documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    issues = spark.read.schema(_ISSUES.replace("doc_id long", f"doc_id {ids}")).parquet(f"{target}/issues")
    return issues.join(last.hint("merge"), ["doc_id", "batch"]).drop("batch")


def latest_status(tasks: DataFrame, final: tuple[str, ...] = ()) -> DataFrame:
    """The newest stage and progress of each task of a table, or those at which it has ended; status.task_status does it for a stream."""
    return final_status(tasks, final).drop("final")


def stage_counts(tasks: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Updates and mean progress of each stage in windows of event time."""
    return tasks.withWatermark("updated_at", late).groupBy(F.window("updated_at", size), "current_stage").agg(F.count("*").alias("n"), F.round(F.avg("progress"), 6).alias("mean")).select(F.col("window.start").alias("start"), "current_stage", "n", "mean")
