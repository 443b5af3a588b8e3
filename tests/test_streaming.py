"""Streams fed file by file, against the batch operators."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from tests.helpers import ZERO_US, at, change, change_frame, tuples, with_us
from tidemark.functions.records import to_records
from tidemark.operators import duplicates as batch
from tidemark.operators import windows as batch_windows
from tidemark.sinks import ndjson, publish
from tidemark.sources import tables
from tidemark.streaming import duplicates, late
from tidemark.streaming.windows import (
    stream_tables,
    stream_window_counts,
    union_streams,
    write_record_files,
)

MINUTE = 60_000_000


class Feed:
    """Change tables on disk and a query over them that is run batch by batch."""

    def __init__(self, spark, path, names):
        self.spark, self.root, self.out = spark, f"{path}/tables", f"{path}/out"
        self.checkpoint = f"{path}/checkpoint"
        self.queries = []
        tables.create_tables(spark, self.root, names)

    def add(self, rows):
        tables.append_changes(change_frame(self.spark, rows).coalesce(1), self.root)

    def run(self, stream, mode="append"):
        query = (
            stream.writeStream.format("parquet")
            .option("path", self.out)
            .option("checkpointLocation", self.checkpoint)
            .outputMode(mode)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        self.queries.append(query)
        return self.spark.read.schema(stream.schema).parquet(self.out)


def test_flag_over_several_batches_is_the_batch_flag(spark, tmp_path):
    """Keys repeat within a batch and across batches; the query is started anew each time."""
    rng = random.Random(1)
    feed = Feed(spark, tmp_path, ["t1", "t2"])
    rows = []
    for n in range(3):
        some = [
            change(rng.choice(["t1", "t2"]), rng.choice(["hot", str(rng.randrange(40)), None]),
                   at(f"00:{n:02}:{i % 60:02}.{i:06}"))
            for i in range(150)
        ]
        rows += some
        feed.add(some)
        both = union_streams([tables.stream_table(spark, feed.root, t) for t in ("t1", "t2")])
        keyed = with_us(both).select("table_name", "event_id", "us")
        got = feed.run(duplicates.flag_duplicates(keyed))
    plain = with_us(change_frame(spark, rows)).select("table_name", "event_id", "us")
    want = batch.flag_duplicates(plain, row_id=[])
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_same_key_in_another_table_is_no_duplicate(spark, tmp_path):
    feed = Feed(spark, tmp_path, ["t1", "t2"])
    feed.add([change("t1", "1", at("00:00:01")), change("t2", "1", at("00:00:01"))])
    both = union_streams([tables.stream_table(spark, feed.root, t) for t in ("t1", "t2")])
    got = feed.run(duplicates.flag_duplicates(to_records(both)))
    assert tuples(got, "table_name", "payload.order_id", "is_duplicate") == [
        ("t1", "o-1", False),
        ("t2", "o-1", False),
    ]


def test_flag_with_ttl(spark, tmp_path):
    feed = Feed(spark, tmp_path, ["t1"])
    feed.add([change("t1", "1", at("00:00:01")), change("t1", "1", at("00:00:02"))])
    stream = with_us(tables.stream_table(spark, feed.root, "t1")).select(
        "table_name", "event_id", "us"
    )
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        got = feed.run(duplicates.flag_duplicates(stream, ttl_ms=3_600_000))
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [x for _, x in tuples(got, "us", "is_duplicate")] == [False, True]


def test_local_repeats_are_marked_by_time(spark):
    rows = [("a", 3), ("b", 1), ("a", 1), ("a", 2), (None, 5), (None, 4)]
    df = spark.createDataFrame(rows, "event_id string, us long").coalesce(1)
    marked = duplicates.mark_local_repeats(df, ["event_id"], ["us"])
    assert [tuple(r) for r in marked.collect()] == [
        ("a", 3, True),
        ("b", 1, False),
        ("a", 1, False),
        ("a", 2, True),
        (None, 5, True),
        (None, 4, False),
    ]


def test_drop_within_watermark(spark, tmp_path):
    feed = Feed(spark, tmp_path, ["t1"])
    stream = with_us(tables.stream_table(spark, feed.root, "t1", "10 minutes"))
    kept = duplicates.drop_duplicates(stream, ["table_name", "event_id"])
    feed.add([change("t1", k, at(f"00:00:0{i}")) for i, k in enumerate("aabca")])
    feed.run(kept.select("table_name", "event_id"))
    feed.add([change("t1", k, at(f"00:01:0{i}")) for i, k in enumerate("cd")])
    got = feed.run(kept.select("table_name", "event_id"))
    assert tuples(got, "event_id") == [("a",), ("b",), ("c",), ("d",)]


def test_windows_are_the_batch_windows_up_to_the_watermark(spark, tmp_path):
    rng = random.Random(2)
    feed = Feed(spark, tmp_path, ["t1", "t2"])
    rows = []
    for minute in range(0, 12, 4):
        some = [
            change(t, "1", at(f"00:{minute + rng.randrange(4):02}:{rng.randrange(60):02}"))
            for t in ("t1", "t2")
            for _ in range(30)
        ]
        # One row per table closes the minutes before.
        some += [change(t, "1", at(f"00:{minute + 3:02}:59.5")) for t in ("t1", "t2")]
        rows += some
        feed.add(some)
        stream = stream_tables(spark, feed.root, ["t1", "t2"], "30 seconds")
        got = feed.run(stream_window_counts(stream))
    records = to_records(change_frame(spark, rows))
    mark = ZERO_US + 11 * MINUTE + 29_500_000
    want = batch_windows.window_counts(records).filter(F.col("win_end_us") <= mark)
    columns = ["table_name", "win_start_us", "win_end_us", "rows", "min_us", "max_us"]
    assert tuples(got, *columns) == tuples(want, *columns)
    assert got.count() == 22


def test_late_row_is_dropped_and_counted(spark, tmp_path):
    feed = Feed(spark, tmp_path, ["t1"])

    def step(*stamps):
        feed.add([change("t1", "1", at(s)) for s in stamps])
        stream = stream_tables(spark, feed.root, ["t1"], "30 seconds")
        return feed.run(stream_window_counts(stream))

    step("00:10:00")
    step("00:11:00")
    got = step("00:01:00", "00:12:00")
    dropped = sum(
        op["numRowsDroppedByWatermark"]
        for progress in feed.queries[-1].recentProgress
        for op in json.loads(progress.json)["stateOperators"]
    )
    assert dropped == 1
    starts = [(us - ZERO_US) // MINUTE for (us,) in tuples(got, "win_start_us")]
    assert starts == [10]


def test_late_drop_replay_is_what_the_stream_drops(spark):
    """The same three polls in batch; the row of the third comes after its window has closed."""
    rows = [("t1", 0, 10), ("t1", 1, 11), ("t1", 2, 1), ("t1", 2, 12)]
    polled = spark.createDataFrame(
        [(t, k, ZERO_US + m * MINUTE) for t, k, m in rows], "table_name string, poll long, us long"
    )
    for behind in (1, 2):
        judged = batch_windows.late_drop(polled, ZERO_US, 30, 60, behind)
        got = [((us - ZERO_US) // MINUTE, x) for us, x in tuples(judged, "us", "is_dropped")]
        assert got == [(1, True), (10, False), (11, False), (12, False)]


def test_slow_table_holds_all_windows_back(spark, tmp_path):
    feed = Feed(spark, tmp_path, ["t1", "t2"])
    feed.add([change("t1", "1", at(f"00:0{m}:00")) for m in range(6)])
    feed.add([change("t2", "1", at("00:00:30"))])
    stream = stream_tables(spark, feed.root, ["t1", "t2"], "30 seconds")
    assert feed.run(stream_window_counts(stream)).count() == 0
    marks = {p.eventTime.get("watermark") for p in feed.queries[-1].recentProgress}
    assert marks <= {None, "1970-01-01T00:00:00.000Z", "2024-01-01T00:00:00.000Z"}


def test_record_files_keep_late_rows(spark, tmp_path):
    feed = Feed(spark, tmp_path, ["t1"])
    out, checkpoint = str(tmp_path / "files"), str(tmp_path / "files-checkpoint")
    for stamps in (["00:10:00.000001"], ["00:11:00"], ["00:01:00", "00:12:00"]):
        feed.add([change("t1", "1", at(s)) for s in stamps])
        stream = tables.stream_table(spark, feed.root, "t1", "30 seconds")
        write_record_files(to_records(stream), out, checkpoint).awaitTermination()
    lines = ndjson.read_windows(spark, out)
    wins = sorted(r.win[9:13] for r in lines.collect())
    assert wins == ["0001", "0010", "0011", "0012"]
    stamps = {json.loads(r.value)["change_timestamp"][11:] for r in lines.collect()}
    assert "00:10:00.000001+00:00" in stamps
    merged = str(tmp_path / "merged")
    publish.publish_windows(spark, out, merged, closed_before="20240101-001200")
    assert publish.read_published(spark, merged).count() == 3


def test_windows_of_one_input_task_are_opened_by_many(spark, tmp_path):
    rows = [change("t1", "1", at(f"{m // 60:02}:{m % 60:02}:00")) for m in range(64)]
    source, out = str(tmp_path / "source"), tmp_path / "files"
    change_frame(spark, rows).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    write_record_files(to_records(stream), str(out), str(tmp_path / "checkpoint")).awaitTermination()
    names = [f.name for f in out.glob("dest=*/win=*/part-*")]
    assert len(names) == 64 and len({n[:10] for n in names}) > 1
    assert not list(out.glob("dest=*/win=*/.*.crc"))
    assert ndjson.read_windows(spark, str(out)).count() == 64
    assert spark.conf.get("fs.file.impl", None) is None


def test_arrivals_replayed_in_order(spark, tmp_path):
    """A row two steps behind is dropped, one a step behind is not: the watermark is that of the batch before."""
    minutes = [(0, "t1", 10), (1, "t1", 30), (2, "t1", 10), (2, "t2", 31), (3, "t1", 28), (3, "t2", 28), (3, "t1", 28), (4, "t1", 90), (5, "t1", 91)]
    rows = [(step, t, at(f"{m // 60:02}:{m % 60:02}:00")) for step, t, m in minutes]
    arrivals = spark.createDataFrame(rows, "step long, table_name string, change_timestamp timestamp")
    kept, dropped = late.replay_arrivals(arrivals, str(tmp_path), "30 seconds", 60)
    starts = [(t, (us - ZERO_US) // MINUTE, n) for t, us, n in tuples(kept, "table_name", "win_start_us", "rows")]
    assert starts == [("t1", 10, 2), ("t1", 30, 1), ("t2", 31, 1)]
    # In the last step with such rows two windows of tables came too late, one of them twice.
    assert tuples(dropped, "step", "dropped_groups") == [(0, 0), (1, 0), (2, 0), (3, 2), (4, 0), (5, 0)]
    none = late.replay_arrivals(arrivals.limit(0), str(tmp_path / "none"), "30 seconds", 60)
    assert [df.count() for df in none] == [0, 0]
