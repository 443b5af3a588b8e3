"""Physical plans: what reaches the scan, and what is shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import ZERO_US, at, change, change_frame
from tidemark.operators import duplicates, polls, replay, windows
from tidemark.plans import feeds, queries
from tidemark.sources import scan, tables

SF = "/root/testdata/sf0.001"
DAY = 86_400_000_000


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    days = [at(f"{24 * d}:00:01") for d in range(10)]
    rows = [change(t, str(i), day) for t in ("t1", "t2") for i, day in enumerate(days)]
    tables.append_changes(change_frame(spark, rows), path)
    return path


def test_range_and_columns_reach_the_files(spark):
    rows = scan.poll_scan_micros(feeds.changes(spark, SF), ZERO_US, ZERO_US + DAY)
    text = plan(rows.select("event_id", "change_type"))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text
    assert "Exchange" not in text


def test_day_partitions_are_pruned(spark, root):
    table = tables.read_table(spark, root, "t1")
    rows = scan.poll_scan_micros(table, ZERO_US + 2 * DAY, ZERO_US + 4 * DAY)
    text = plan(rows)
    assert re.search(r"PartitionFilters: \[.*change_date", text)
    assert rows.count() == 2
    assert len({r[0] for r in rows.select(F.input_file_name()).collect()}) == 2


def test_one_scan_serves_many_tables(spark, root):
    ranges = [("t1", ZERO_US, ZERO_US + DAY), ("t2", ZERO_US + DAY, ZERO_US + 3 * DAY)]
    rows = tables.scan_tables(spark, root, ranges)
    text = plan(rows)
    assert text.count("Scan parquet") == 2  # the plan's tree and the details of the same node
    assert "BroadcastHashJoin" in text and "GreaterThanOrEqual(change_timestamp" in text
    assert len(rows.inputFiles()) == 6  # three days listed for each
    assert re.search(r"PartitionFilters: \[.*change_date.* OR ", text)
    assert rows.count() == 3


def test_replay_shuffles_no_rows(spark):
    """With few polls, rows go from scan to result without an exchange of their own."""
    text = plan(replay.lookback_replay(feeds.changes(spark, SF), queries.START, queries.STEP))
    assert "BroadcastHashJoin" in text
    assert "SortMergeJoin" not in text and "Cartesian" not in text and "NestedLoop" not in text
    assert text.count("Arguments: hashpartitioning") == 0


def test_aggregates_combine_before_the_shuffle(spark):
    for df in (
        windows.window_counts(queries._records(spark, SF)),
        polls.poll_facts(polls.with_poll(feeds.changes(spark, SF), queries.START, queries.STEP)),
    ):
        text = plan(df, "simple")
        assert text.index("partial_count") > text.index("Exchange hashpartitioning")
        assert text.count("Exchange") == 1 and "SortAggregate" not in text


@pytest.mark.parametrize("name", ["lookback_replay", "dup_flag", "late_drop", "multi_table_fanin"])
def test_no_cross_joins(spark, name):
    text = plan(queries.registered()[name](spark, SF))
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_duplicate_flag_shuffles_rows_only_when_it_must(spark):
    rows = feeds.changes(spark, SF).select("table_name", "event_id", "us")
    few = duplicates.flag_duplicates(rows, row_id=[])
    assert "Exchange hashpartitioning" not in plan(few, "simple")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        many = duplicates.flag_duplicates(rows, row_id=[], broadcast_rows=0, hot_groups=5)
        text = plan(many, "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("BroadcastHashJoin") == 1 and text.count("SortMergeJoin") == 1


def test_duplicate_flags_need_no_sort_of_all_rows(spark):
    """Positions are aggregated by hash; with distinct positions nothing is sorted for the flag."""
    rows = spark.range(1000).selectExpr(
        "'t' as table_name", "cast(id % 7 as string) as event_id", "id as us", "cast(id as string) as order_id"
    )
    flagged = duplicates.flag_duplicates(rows, row_id=["order_id"])
    assert "SortAggregate" not in flagged._jdf.queryExecution().executedPlan().toString()
    assert flagged.filter("not is_duplicate").count() == 7


def test_staged_tables_of_a_block_are_removed(spark):
    from tidemark.session import cleared, folder_exists, shared_path, stage

    path = shared_path(spark, "kept")
    spark.range(3).write.parquet(path)
    inside = []
    with cleared(spark):
        with cleared(spark):
            inside.append(shared_path(spark, "inner"))
            spark.range(2).write.parquet(inside[0])
        assert not folder_exists(spark, inside[0])
        held = stage(spark.range(5), "outer")
        inside.append(held.inputFiles()[0].rsplit("/", 1)[0])
        assert held.count() == 5
    assert not any(folder_exists(spark, p) for p in inside) and folder_exists(spark, path)
