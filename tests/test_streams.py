"""Streams over several batches, and against the same over whole tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillsieve.plans.audit import audit
from quillsieve.sources.views import view
from quillsieve.streaming.jobs import current_issues, incremental_audit, latest_status
from quillsieve.streaming.status import final_status, status_table, write_task_status

SCHEMA = "id long, event_id long, updated_at timestamp, current_stage string, progress double"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.fixture
def tasks(spark, tmp_path):
    """Puts a batch of updates and runs the stream; returns the last batch's changes and the stream's progress."""

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = write_task_status(source, str(tmp_path / "out"), str(tmp_path / "check"), late="100 seconds", keep_hours=1)
        query.awaitTermination()
        return {r.id: (r.current_stage, r.progress, r.final) for r in status_table(spark, str(tmp_path / "out")).collect()}, query

    return put


def test_task_status_over_batches(tasks, spark, tmp_path):
    got, _ = tasks([(1, 1, at(0), "parse", 0.1), (1, 2, at(10), "audit", 0.5), (2, 3, at(20), "parse", None), (3, 4, at(30), "done", 1.0), (3, 5, at(40), "audit", 0.4), (None, 6, at(0), "parse", 0.0)])
    assert got == {1: ("audit", 0.5, False), 2: ("parse", None, False), 3: ("done", 1.0, True)}
    # older than what is known, but not late; after an end; the first of two ends; a newer one
    got, _ = tasks([(1, 7, at(5), "parse", 0.2), (3, 8, at(50), "parse", 0.0), (4, 9, at(70), "failed", 0.3), (4, 10, at(60), "done", 1.0), (2, 11, at(500), "report", 0.9)])
    assert got == {1: ("audit", 0.5, False), 2: ("report", 0.9, False), 3: ("done", 1.0, True), 4: ("done", 1.0, True)}
    # the watermark is at 400 now: an update at 300 is late and dropped, one at 450 is not
    got, query = tasks([(1, 12, at(300), "report", 0.6), (2, 13, at(450), "parse", 0.1), (5, 14, at(450), "parse", 0.1)])
    assert got[1] == ("audit", 0.5, False) and got[2] == ("report", 0.9, False) and got[5] == ("parse", 0.1, False)
    rows = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    # an hour of event time later, timers have ended the state of all tasks but the new one
    got, query = tasks([(6, 15, at(9000), "parse", 0.1)])
    left = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert got[6] == ("parse", 0.1, False) and max(rows) > left[-1] > 0
    every = spark.read.parquet(str(tmp_path / "in")).where("event_id <> 12")
    want = {r.id: (r.current_stage, r.progress, r.final) for r in final_status(every).collect()}
    assert got == want


def test_latest_status_of_a_table(spark):
    rows = [(1, 1, at(0), "parse", 0.1), (1, 2, at(0), "audit", 0.2), (2, 3, at(9), "done", 1.0), (2, 4, at(8), "failed", 0.7), (2, 5, at(10), "parse", 0.0), (3, 6, None, "parse", 0.0), (4, None, at(1), None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.id: (r.current_stage, r.progress) for r in latest_status(df).collect()} == {1: ("audit", 0.2), 2: ("parse", 0.0), 4: (None, None)}
    assert {r.id: (r.current_stage, r.progress) for r in latest_status(df, ("done", "failed")).collect()} == {1: ("audit", 0.2), 2: ("failed", 0.7), 4: (None, None)}
    assert latest_status(df.limit(0)).count() == 0


def test_incremental_audit_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    sections, refs = view(spark, sf, "sections"), view(spark, sf, "refs")
    of = lambda df: {"sections": sections.join(df.select("doc_id"), "doc_id", "left_semi"), "refs": refs.join(df.select("doc_id"), "doc_id", "left_semi")}
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
    incremental_audit(stream, of, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got, want = current_issues(spark, str(tmp_path / "out")), audit(of(docs))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert got.where("pack = 'references'").count() > 0


def test_a_document_that_arrives_again_replaces_its_issues(spark, tmp_path):
    schema = "doc_id long, lines array<string>, entries array<string>"

    def of(df):
        sections = df.select("doc_id", F.posexplode("lines").alias("pos", "text")).selectExpr("doc_id", "pos", "pos section_id", "'paragraph' type", "0 level", "text", "12.0D size_pt", "'SimSun' font", "1.5D line_spacing", "2.0D first_line_indent")
        refs = df.select("doc_id", F.posexplode("entries").alias("at", "raw_text")).selectExpr("doc_id", "at + 1 ref_pos", "concat('[', at + 1, ']') ref_id", "raw_text")
        return {"sections": sections, "refs": refs}

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental_audit(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), of, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return sorted((r.doc_id, r.rule_id) for r in current_issues(spark, str(tmp_path / "out")).where("rule_id like 'ERR_REF_THESIS%'").collect())

    bad, good = "[1] LIU Y. Work[D]. Somewhere.", "[1] LIU Y. Work[D]. Some University, 2010."
    assert put([(1, ["a long enough paragraph"], [bad]), (2, ["x"], [bad])]) == [(d, f"ERR_REF_THESIS_NO_{x}") for d in (1, 2) for x in ("UNIVERSITY", "YEAR")]
    assert put([(1, ["a long enough paragraph"], [good])]) == [(2, "ERR_REF_THESIS_NO_UNIVERSITY"), (2, "ERR_REF_THESIS_NO_YEAR")]
    assert put([(2, [], []), (1, ["x"], [bad])]) == [(1, "ERR_REF_THESIS_NO_UNIVERSITY"), (1, "ERR_REF_THESIS_NO_YEAR")]
