"""Aggregates over issues, reviews and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sql import SqlOperator
from ..sources.scratch import Tables

score_impact = SqlOperator("issues", "select doc_id, big(sum(case upper(severity_name) when 'CRITICAL' then 10 when 'HIGH' then 5 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end)) as score from {issues} group by doc_id")
audit_summary = SqlOperator(
    "issues",
    """select doc_id, count(*) as total, big(sum(case when upper(severity_name) in ('HIGH', 'CRITICAL') then 1 else 0 end)) as high, big(sum(case when upper(severity_name) = 'MEDIUM' then 1 else 0 end)) as medium, big(sum(case when upper(severity_name) = 'LOW' then 1 else 0 end)) as low from {issues} group by doc_id""",
)
#: Counts of chunks, sections, references and issues of each document, each counted before they are joined.
review_summary = SqlOperator(
    "sections issues chunks",
    """with s as (select doc_id, count(*) as sections from {sections} group by doc_id), i as (select doc_id, count(*) as issues from {issues} group by doc_id), c as (select doc_id, count(*) as chunks from {chunks} group by doc_id)
select /*+ merge(s, i, c) */ s.doc_id, sections, coalesce(issues, 0) as issues, coalesce(chunks, 0) as chunks from s left join i on i.doc_id = s.doc_id left join c on c.doc_id = s.doc_id""",
)
#: How often each code was raised, with subtotals by type and in all.
rule_histogram = SqlOperator("issues", "select issue_type, rule_id, count(*) as n, count(distinct doc_id) as docs from {issues} group by rollup(issue_type, rule_id)")
#: Format errors (codes that begin with ERR_) for a hundred references; null without references.
detection_rate = SqlOperator(
    "issues refs",
    "select errors, listed, case when listed > 0 then round(errors * 100.0e0 / listed, 6) end as rate from (select count(*) as errors from {issues} where substring(rule_id, 1, 4) = 'ERR_') i cross join (select count(*) as listed from {refs}) r",
)
#: Shares at which latency_stats tells values.
SHARES = (0.5, 0.9, 0.99)


def latency_stats(tasks: DataFrame, by: str, value: str, ok: Column, at: str, tie: str, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """For each `by`: tasks, succeeded (ok holds), success_rate, mean, least, most, the value at each share (p50, p90, p99: the one whose
    place in order is the share of all, rounded up), and throughput, tasks a second from the first `at` to the last.

    Exact by distributed selection: rows are dealt by ranges of (by, value, tie) and written, each range counts its rows of each
    group, and sums of these few counts say in which range and at which place a wanted value stands; only those ranges are read
    again and numbered. A group that holds most rows is many ranges, also where its values are equal (`tie` parts them).
    Rows without a value count as tasks, but not for values; where first and last are one time, throughput is null."""
    scratch = Tables(tasks.sparkSession, "latency")
    rows = tasks.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"), F.xxhash64(tie).alias("t"))
    rows = rows.where("v is not null").repartitionByRange("g", "v", "t")
    rows = scratch.write(rows.withColumn("part", F.spark_partition_id()), "ranges")
    parts = rows.groupBy("g", "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("g").orderBy("part")
    parts = parts.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("g")))
    name = lambda p: f"p{round(p * 100):d}"
    places = F.explode(F.array(*[F.struct(F.lit(name(p)).alias("name"), F.greatest(F.ceil(F.col("all") * p), F.lit(1)).alias("place")) for p in shares]))
    wanted = parts.select("*", places.alias("w")).where("w.place > before and w.place <= before + n").select(F.col("g").alias("h"), F.col("part").alias("range"), "w.name", (F.col("w.place") - F.col("before")).alias("place"))
    near = rows.join(wanted.hint("merge"), F.col("g").eqNullSafe(F.col("h")) & (F.col("part") == F.col("range")))
    found = near.withColumn("k", F.row_number().over(Window.partitionBy("g", "name").orderBy("v", "t"))).where("k = place")
    found = found.groupBy("g").agg(*[F.max(F.when(F.col("name") == name(p), F.col("v"))).alias(name(p)) for p in shares])
    seconds = F.max(at).cast("timestamp").cast("double") - F.min(at).cast("timestamp").cast("double")
    told = tasks.groupBy(F.col(by).alias("g")).agg(
        F.count("*").alias("tasks"), F.count_if(ok).alias("succeeded"), F.round(F.count_if(ok) / F.count("*"), 6).alias("success_rate"), F.round(F.avg(value), 6).alias("mean"),
        F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.count("*") / F.nullif(seconds, F.lit(0.0)), 6).alias("throughput"),
    )
    out = told.join(found.withColumnRenamed("g", "h").hint("merge"), F.col("g").eqNullSafe(F.col("h")), "left").drop("h")
    return out.withColumnRenamed("g", by)


#: Tasks of all stages, newest first; task_listing_of() those of one stage.
task_listing = SqlOperator("tasks", "select id, event_id, current_stage, size from {tasks} order by id desc, event_id desc")


def task_listing_of(tasks: DataFrame, stage: str) -> DataFrame:
    """Tasks of one stage, newest first."""
    return task_listing(tasks).where(F.col("current_stage") == stage)


def tasks_older_than(tasks: DataFrame, days: float, stages: tuple[str, ...], now: Column | None = None) -> DataFrame:
    """Of each task its last update (by updated_at, event_id), if that is one of the stages and at least `days` before now, newest ids first.

    Rows without a time are no updates; a null id is a task of its own."""
    row = F.struct(*[F.col(c) for c in tasks.columns])
    last = tasks.where("updated_at is not null").groupBy("id").agg(F.max_by(row, F.struct("updated_at", "event_id")).alias("t")).select("t.*")
    cutoff = (now if now is not None else F.current_timestamp()).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0))
    return last.where(F.col("current_stage").isin(*stages) & (F.col("updated_at").cast("timestamp") <= cutoff)).orderBy(F.desc("id"))


def retention(tasks: DataFrame, days: dict[str, float], now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What a clean-up after so many days for each stage would take: (current_stage, tasks, bytes), and the updates of all tasks that stay.

    Nothing is deleted: writing the second table is the clean-up, leaving it is a dry run."""
    marked = None
    for stage, n in days.items():
        some = tasks_older_than(tasks, n, (stage,), now).select("id", "current_stage", "size")
        marked = some if marked is None else marked.unionByName(some)
    plan = marked.groupBy("current_stage").agg(F.count("*").alias("tasks"), F.sum("size").cast("long").alias("bytes"))
    return plan, tasks.join(marked.select(F.col("id").alias("gone")).hint("merge"), F.col("id").eqNullSafe(F.col("gone")), "left_anti")


task_latest = SqlOperator("tasks", "select id, current_stage, progress from (select *, row_number() over (partition by id order by updated_at desc, event_id desc) as k from {tasks}) t where k = 1")
#: Tasks whose last update is over an hour before the newest one, by stage: how many, and bytes.
retention_plan = SqlOperator(
    "tasks",
    """with n as (select max(updated_at) as newest from {tasks}), l as (select *, row_number() over (partition by id order by updated_at desc, event_id desc) as k from {tasks})
select current_stage, count(*) as tasks, big(sum(size)) as bytes from l cross join n where k = 1 and updated_at <= newest - interval '1' hour group by current_stage""",
)


def reports(issues: DataFrame) -> DataFrame:
    """One JSON report for each document: its issues in order, and their count."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "k", "rule_id", "severity_name", "original")))
    return issues.groupBy("doc_id").agg(F.to_json(F.struct(F.col("doc_id"), F.count("*").alias("issues_count"), rows.alias("issues"))).alias("report"))


def report_counts(documents: DataFrame, chunk_issues: DataFrame, verdicts: DataFrame, consistency: DataFrame) -> DataFrame:
    """Issues of each document's report: those of its chunks, its references with a verdict other than `verified`, and its
    consistency issues. Each is counted by itself before they are joined; a null or empty verdict is none."""
    unverified = verdicts.where((F.col("verdict") != "verified") & (F.col("verdict") != ""))
    out = documents.select("doc_id").distinct()
    for df, name in ((chunk_issues, "chunk_issues"), (unverified, "unverified"), (consistency, "consistency")):
        out = out.join(df.groupBy("doc_id").agg(F.count("*").alias(name)).hint("merge"), "doc_id", "left")
    n = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chunk_issues", "unverified", "consistency")]
    return out.select("doc_id", *n).withColumn("issues_count", F.col("chunk_issues") + F.col("unverified") + F.col("consistency"))


def compact_views(views: DataFrame, signature: list[str]) -> DataFrame:
    """Views of a chunk's issues (doc_id, chunk, view, seq, signature columns) as a report keeps them, one row for each view.

    Views are `issues`, `local_issues`, `llm_issues` and `table_issues`. Of equal issues in a view the first stays. Where
    `issues` has none it becomes the others in that order, each issue once. Views equal to it are dropped. Returns doc_id,
    chunk, view, n and entries (the signatures in order, `|` between columns and `;` between issues)."""
    rank = F.when(F.col("view") == "local_issues", 1).when(F.col("view") == "llm_issues", 2).when(F.col("view") == "table_issues", 3).otherwise(0)
    entry = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in signature])
    rows = views.select("doc_id", "chunk", "view", "seq", rank.alias("rank"), entry.alias("entry"))
    once = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "chunk", "view", "entry").orderBy("seq"))).where("k = 1")
    listed = lambda order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "entry"))), lambda x: x.entry), ";")
    each = once.groupBy("doc_id", "chunk", "view").agg(F.count("*").alias("n"), listed(["seq"]).alias("entries"))
    has = F.max(F.when(F.col("view") == "issues", 1).otherwise(0)).over(Window.partitionBy("doc_id", "chunk"))
    rest = once.withColumn("has", has).where((F.col("has") == 0) & (F.col("view") != "issues"))
    first = rest.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "chunk", "entry").orderBy("rank", "seq"))).where("k = 1")
    merged = first.groupBy("doc_id", "chunk").agg(F.count("*").alias("n"), listed(["rank", "seq"]).alias("entries")).select("doc_id", "chunk", F.lit("issues").alias("view"), "n", "entries")
    all_ = each.unionByName(merged)
    main = F.max(F.when(F.col("view") == "issues", F.col("entries"))).over(Window.partitionBy("doc_id", "chunk"))
    return all_.withColumn("main", main).where((F.col("view") == "issues") | (F.col("entries") != F.col("main"))).drop("main")
