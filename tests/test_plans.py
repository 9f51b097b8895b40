"""Physical plans: derived tables are not broadcast, and bucketed papers are joined without a shuffle."""

import pytest

from quillsieve.queries import QUERIES

JOINING = "missing_refs unused_refs bidirectional_refs ref_list_order review_summary abbreviations abstract_overlap required_sections missing_ref_entries unused_ref_entries table_row_chunks report_counts".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINING)
def test_no_broadcast_of_derived_tables(spark, name):
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    lines = [x for x in text.splitlines() if "BroadcastHashJoin" in x or "Cartesian" in x]
    assert all("l_partkey" in x for x in lines), lines  # the view `refs` itself reads two given tables


def test_bucketed_papers_join_without_a_shuffle(spark):
    from quillsieve.sources.ingest import save_papers, stored_papers

    schema = "paper_id string, title string, document string, ingested_at long"
    name = "papers_of_test_plans"
    spark.sql(f"drop table if exists {name}")
    first = [("a", "old", "x", 1), ("b", "kept", "y", 1), (None, None, "own id", 1), ("c", "twice", "z", 1), ("c", "later", "z", 3), ("c", "middle", "z", 2)]
    save_papers(spark.createDataFrame(first, schema), name, buckets=4)
    save_papers(spark.createDataFrame([("a", "new", "x2", 2), ("d", "added", "w", 2), ("c", "too old", "z", 0), ("b", None, None, 5)], schema), name, buckets=4)
    got = {r.paper_id: r.title for r in stored_papers(spark, name).collect()}
    assert {k: v for k, v in got.items() if len(k) == 1} == {"a": "new", "b": None, "c": "later", "d": "added"} and len(got) == 5
    other = spark.table(name)
    joined = stored_papers(spark, name).join(other.withColumnsRenamed({"title": "t"}).hint("merge"), "paper_id")
    text = plan(joined)
    assert "SortMergeJoin" in text and "Exchange" not in text and joined.count() == 5
    spark.sql(f"drop table {name}")
