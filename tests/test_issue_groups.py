"""Large groups: near copies of a million issues, spans in long texts, percentiles of one hot stage."""

import math
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillsieve.operators import issues, report


def greedy(rows, tolerance):
    """The definition: rows of one group in order."""
    kept = []
    for at, s, e in rows:
        if not any(a is None or b is None or s is None or e is None or (abs(a - s) <= tolerance and abs(b - e) <= tolerance) for _, a, b in kept):
            kept.append((at, s, e))
    return kept


@pytest.mark.parametrize("tolerance", [0, 1, 3])
def test_sweep_equals_the_definition(spark, tolerance):
    rng = random.Random(tolerance)
    span = lambda: (None, None) if rng.random() < 0.02 else (rng.randint(-5, 40), rng.choice([None, *range(60)]) if rng.random() < 0.05 else rng.randint(0, 60))
    rows = [(rng.randint(1, 4), rng.choice(["a", None]), rng.choice(["x", "y"]), k, *span()) for k in range(600)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, issue_type string, label string, at int, start_char int, end_char int, n string").repartition(4)
    got = sorted(map(str, ((r.doc_id, r.issue_type, r.label, r["at"], r.start_char, r.end_char) for r in issues.near_distinct_issues(df, ["doc_id"], tolerance).collect())))
    groups = {}
    for d, t, lab, *rest in rows:
        groups.setdefault((d, t, lab), []).append(rest)
    assert got == sorted(map(str, ((*g, *x) for g, own in groups.items() for x in greedy(own, tolerance))))


def test_a_group_of_a_million_issues():
    rng = random.Random(1)
    starts = [rng.randint(0, 3_000_000) for _ in range(1_000_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1] * len(starts), "at": list(range(len(starts))), "start_char": starts, "end_char": [s + 5 for s in starts]})
    table = pa.Table.from_batches([batch]).to_batches(max_chunksize=10_000)
    began = time.time()
    kept = sum(b.num_rows for b in issues._sweep(["doc_id"], 3)(iter(table)))
    assert 300_000 < kept < 800_000 and time.time() - began < 60


def test_spans_in_a_long_text(spark):
    text = "é" + "abc " * 2_600_000 + "needle " + "xyz " * 100 + "needle"
    at = text.index("needle")
    rows = [("1", at - 10), ("2", at + 5), ("3", len(text)), ("4", None), ("5", -3)]
    df = spark.createDataFrame(rows, "id string, start_char int").select("id", F.lit(text).alias("text"), F.lit("needle").alias("original"), "start_char", (F.col("start_char") + 6).alias("end_char"))
    last = text.rindex("needle")
    assert {r.id: (r.new_start, r.new_end) for r in issues.relocated_spans(df).select("id", "new_start", "new_end").collect()} == {"1": (at, at + 6), "2": (at, at + 6), "3": (last, last + 6), "4": (at, at + 6), "5": (at, at + 6)}


def test_spans_equal_plain_search(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab日") for _ in range(n))
    rows = [(k, rng.choice([None, "", word(3), word(30)]), rng.choice([None, "", word(1), word(2), word(3)]), rng.choice([None, *range(0, 34)]), rng.randint(0, 34)) for k in range(400)]
    got = {r.id: r.new_start for r in issues.relocated_spans(spark.createDataFrame(rows, "id int, text string, original string, start_char int, end_char int")).collect()}
    for k, text, original, s, e in rows:
        want = None
        if text is not None and original is not None and s is not None and text[s:e] == original:
            want = s
        elif text and original:
            places = [i for i in range(len(text)) if text.startswith(original, i)]
            want = min(places, key=lambda i: (abs(i - (s or 0)), i), default=None)
        assert got[k] == want, (text, original, s, e)


def test_percentiles_of_a_hot_stage(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.randint(0, 5)), k) for k in range(3000)] + [("cold", None, 1), ("one", 7.5, 2), (None, 1.0, 3), (None, 2.0, 4)] + [("few", float(k), k) for k in range(10)]
    df = spark.createDataFrame(rows, "stage string, v double, id long").withColumn("at", F.timestamp_seconds("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.stage: r for r in report.latency_stats(df, "stage", "v", F.col("v") > 2, "at", "id").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for stage in {r[0] for r in rows}:
        own = sorted(v for s, v, _ in rows if s == stage and v is not None)
        pick = lambda p: own[max(1, math.ceil(p * len(own))) - 1] if own else None  # noqa: B023, E731
        r = got[stage]
        assert (r.p50, r.p90, r.p99) == (pick(0.5), pick(0.9), pick(0.99))
        assert r.tasks == sum(s == stage for s, *_ in rows) and r.succeeded == sum(v > 2 for v in own)
    assert got["one"].throughput is None and got["hot"].throughput == round(3000 / 2999, 6)
    assert report.latency_stats(df.limit(0), "stage", "v", F.col("v") > 2, "at", "id").count() == 0


def test_old_tasks_and_what_stays(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", "done", 5), (1, 2, "2024-01-02 00:00:00", "failed", 7), (2, 3, "2024-01-01 12:00:00", "done", None), (3, 4, "2024-01-09 00:00:00", "done", 3), (4, 5, None, "done", 1), (None, 6, "2024-01-01 00:00:00", "done", 2)]
    df = spark.createDataFrame(rows, "id long, event_id long, updated_at string, current_stage string, size int").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    now = F.lit("2024-01-10 00:00:00")
    assert [r.event_id for r in report.tasks_older_than(df, 5, ("done", "failed"), now).collect()] == [3, 2, 6]
    assert [r.event_id for r in report.tasks_older_than(df, 1, ("done",), now).collect()] == [4, 3, 6]
    plan, stay = report.retention(df, {"done": 8.25, "failed": 8}, now)
    assert {(r.current_stage, r.tasks, r.bytes) for r in plan.collect()} == {("failed", 1, 7), ("done", 2, 2)}
    assert {r.event_id for r in stay.collect()} == {4, 5}


def test_dates_sizes_and_years(spark):
    from quillsieve.operators.lines import iso_date
    from quillsieve.operators.retrieval import years_of
    from quillsieve.sources.ingest import points_of

    dates = {"2024年1月5日": "2024-01-05", "2024年02月30日": None, "2024年1月": None, "": None, None: None, "x2024年1月5日": None}
    df = spark.createDataFrame([(k,) for k in dates], "v string")
    assert {r[0]: r[1] for r in df.select("v", iso_date(df.v)).collect()} == dates
    sizes = {"24": "12pt", "21": "10.5pt", "20.5": "10.2pt", "21.5": "10.8pt", "x": None, None: None}
    df = spark.createDataFrame([(k,) for k in sizes], "v string")
    assert {r[0]: r[1] for r in df.select("v", points_of(df.v)).collect()} == sizes
    df = spark.createDataFrame([("a 1999, b 20245 c 1850",), (None,)], "v string")
    assert [r[0] for r in df.select(years_of(df.v)).collect()] == [["1999", "2024"], None]
