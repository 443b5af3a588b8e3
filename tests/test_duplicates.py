"""Duplicate flags on bounded data, with keys and copies of any weight."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.helpers import tuples
from tidemark.operators import duplicates
from tidemark.operators.groups import attach_facts, number_copies

WAYS = [{}, {"broadcast_rows": 0, "hot_groups": 2}, {"broadcast_rows": 0, "hot_groups": 0}]


def frame(spark, rows):
    return spark.createDataFrame(rows, "table_name string, event_id string, us long, note string")


def skewed(seed: int) -> list[tuple]:
    """A third of the rows have one key, some keys are NULL, many rows are exact copies."""
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        key = "hot" if rng.random() < 0.34 else rng.choice([None, *map(str, range(100))])
        rows.append((rng.choice(["a", "b"]), key, rng.randrange(5), rng.choice(["x", "y"])))
    return rows + [("c", "once", 9, "x")]


@pytest.mark.parametrize("attach", WAYS)
def test_one_first_row_per_key(spark, attach):
    rows = skewed(1)
    flagged = duplicates.flag_duplicates(frame(spark, rows).repartition(7), **attach)
    assert flagged.columns == ["table_name", "event_id", "us", "note", "is_duplicate"]
    got = flagged.collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    firsts = [r for r in got if not r.is_duplicate]
    smallest = {}
    for table, key, us, note in rows:
        smallest[table, key] = min(smallest.get((table, key), (us, note)), (us, note))
    assert {(r.table_name, r.event_id): (r.us, r.note) for r in firsts} == smallest
    assert len(firsts) == len(smallest)


@pytest.mark.parametrize("attach", WAYS)
def test_row_id(spark, attach):
    rows = [("a", "1", 5, "y"), ("a", "1", 5, "x"), ("a", "2", 1, "z"), ("b", "1", 9, "x")]
    flagged = duplicates.flag_duplicates(frame(spark, rows), row_id=["note"], **attach)
    assert tuples(flagged, "table_name", "event_id", "note", "is_duplicate") == [
        ("a", "1", "x", False),
        ("a", "1", "y", True),
        ("a", "2", "z", False),
        ("b", "1", "x", False),
    ]


def test_copies_are_numbered_whatever_their_number(spark):
    rows = [("a", None, 1, "x")] * 25 + [("a", "1", 1, "x")] * 10 + [("b", "1", 2, "y")]
    numbered = number_copies(frame(spark, rows), chunk=10)
    got = Counter((r.event_id, r.table_name) for r in numbered.collect())
    assert got == {(None, "a"): 25, ("1", "a"): 10, ("1", "b"): 1}
    hot = tuples(numbered.filter("event_id is null"), "copy_no")
    assert hot == [(n,) for n in range(1, 26)]


def test_drop_keeps_the_first(spark):
    rows = [("a", "1", 5, "y"), ("a", "1", 4, "z"), ("a", None, 3, "x"), ("a", None, 2, "x")]
    kept = duplicates.drop_duplicates(frame(spark, rows), ["table_name", "event_id"], ["us"])
    assert sorted(kept.collect(), key=str) == sorted(
        frame(spark, [("a", "1", 4, "z"), ("a", None, 2, "x")]).collect(), key=str
    )


@pytest.mark.parametrize("way", WAYS)
def test_facts_reach_every_row(spark, way):
    rows = frame(spark, skewed(2)).repartition(5)
    facts = rows.groupBy("table_name", "event_id").agg(F.count(F.lit(1)).alias("n"))
    known = attach_facts(
        rows, facts.filter("n > 3"), ["table_name", "event_id"], "n", **way
    )
    count = Counter((t, e) for t, e, _, _ in skewed(2))
    got = known.collect()
    assert len(got) == len(skewed(2))
    for r in got:
        n = count[r.table_name, r.event_id]
        assert r.n == (n if n > 3 else None)


def test_hot_rows_are_not_gathered(spark):
    """With the second way, rows of one key end up in several tasks."""
    rows = spark.range(0, 80_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("event_id"),
        F.lit("t").alias("table_name"),
        F.col("id").alias("us"),
    )
    facts = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        known = attach_facts(rows, facts, ["event_id"], "n", broadcast_rows=0, hot_groups=1)
        tasks = (
            known.filter("event_id = 'hot'")
            .groupBy(F.spark_partition_id().alias("task"))
            .count()
            .collect()
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sum(r["count"] for r in tasks) == 26_667
    assert len(tasks) >= 4
    assert max(r["count"] for r in tasks) < 26_667 / 2
