"""The status of tasks as a stream: keyed state with event-time timers."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Stages that end a task.
FINAL = ("done", "failed")
OUT = "id long, updated_at timestamp, current_stage string, progress double, final boolean"
_STATE = "at long, event_id long, stage string, progress double, final boolean, newest long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TaskStatus(StatefulProcessor):
    """Keeps one row for each task: the first final update if there is one, else the newest. It is given out when it changes.

    Which row that is doesn't depend on the order of arrival. Updates not after the watermark are dropped. `keep` milliseconds of
    event time after a task's newest update its timer ends its state, that of ended tasks too, which until then holds off updates
    that come after the end."""

    def __init__(self, final: tuple[str, ...], keep: int):
        self.final, self.keep = final, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        was = now = tuple(self.state.get()) if self.state.exists() else None
        newest = now[5] if now else None
        for pdf in rows:
            at = pdf["updated_at"].astype("datetime64[us]").astype("int64")
            pdf = pdf.assign(at=at)[pdf["updated_at"].notna() & (at > mark)]
            if not len(pdf):
                continue
            newest = max(newest or 0, int(pdf["at"].max()))
            pdf = pdf.assign(event_id=pdf["event_id"].fillna(-(2**63)).astype("int64"), ended=pdf["current_stage"].isin(self.final)).sort_values(["at", "event_id", "current_stage"], kind="stable")
            ended = pdf[pdf["ended"]]
            r = (ended.iloc[0] if len(ended) else pdf.iloc[-1]).to_dict()
            progress = None if pd.isna(r["progress"]) else float(r["progress"])
            new = (int(r["at"]), int(r["event_id"]), r["current_stage"], progress, bool(r["ended"]))
            if now is None or (new[4] and not now[4]) or (new[4] == now[4] and (new[:2] < now[:2]) == new[4] and new[:2] != now[:2]):
                now = (*new, newest)
        if newest is not None and (was is None or now != was or newest != was[5]):
            self.state.update((*now[:5], newest))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(newest // 1000 + self.keep)
        if now is not None and (was is None or now[:5] != was[:5]):
            yield pd.DataFrame({"id": [key[0]], "updated_at": [pd.Timestamp(now[0], unit="us")], "current_stage": [now[2]], "progress": [now[3]], "final": [now[4]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """Keyed state needs the RocksDB store; a query keeps the store that it was started with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def task_status(tasks: DataFrame, final: tuple[str, ...] = FINAL, late: str = "1 hour", keep_hours: float = 24) -> DataFrame:
    """Updates (id, event_id, updated_at, current_stage, progress) as a stream -> changes of each task's status, in update mode.

    Start the query within rocks(spark). Rows without id are left out, rows without time are dropped."""
    rows = tasks.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("event_id").cast("long").alias("event_id"), F.col("updated_at").cast("timestamp").alias("updated_at"), "current_stage", F.col("progress").cast("double").alias("progress"))
    processor = TaskStatus(tuple(final), int(keep_hours * 3_600_000))
    return rows.withWatermark("updated_at", late).groupBy("id").transformWithStateInPandas(processor, OUT, "Update", "EventTime")


def write_task_status(tasks: DataFrame, target: str, checkpoint: str, **options):
    """Start task_status over a stream: each batch's changes in a folder of their own, which a repeated batch overwrites."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={number}")

    with rocks(tasks.sparkSession):
        return task_status(tasks, **options).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_table(spark: SparkSession, target: str) -> DataFrame:
    """The last change of each task of those that write_task_status has written."""
    changes = spark.read.schema(f"{OUT}, batch long").parquet(target)
    last = F.max_by(F.struct("updated_at", "current_stage", "progress", "final"), "batch")
    return changes.groupBy("id").agg(last.alias("now")).select("id", "now.*")


def final_status(tasks: DataFrame, final: tuple[str, ...] = FINAL) -> DataFrame:
    """The same over a whole table at once: the first final update of each task, else its newest."""
    rows = tasks.where("id is not null and updated_at is not null").withColumn("ended", F.coalesce(F.col("current_stage").isin(*final), F.lit(False)))
    row, order = F.struct("updated_at", "current_stage", "progress", F.col("ended").alias("final")), F.struct("updated_at", "event_id")
    picked = rows.groupBy("id").agg(F.min_by(F.when(F.col("ended"), row), F.when(F.col("ended"), order)).alias("first"), F.max_by(row, order).alias("newest"))
    return picked.select("id", F.coalesce("first", "newest").alias("now")).select("id", F.col("now.updated_at").cast("timestamp").alias("updated_at"), "now.current_stage", "now.progress", "now.final")
