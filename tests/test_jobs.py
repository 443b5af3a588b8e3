"""The command line of the jobs."""

import pytest

from tests.helpers import ZERO_US, at, change, change_frame
from tidemark.plans import jobs
from tidemark.sinks import publish
from tidemark.sources import tables
from tidemark.streaming.poll_loop import PollLoop, stored_tables


def test_create_and_publish(spark, tmp_path):
    source, run, target = (str(tmp_path / name) for name in ("tables", "run", "merged"))
    jobs.main(["create", "--source", source, "--tables", "2"])
    for name in ("events_1", "events_2"):
        assert tables.read_table(spark, source, name).count() == 0
    # Nothing to do before the first poll.
    jobs.main(["publish", "--source", run, "--output", target])
    rows = [change(f"events_{k}", str(n), at(f"00:0{n}:30")) for n in range(4) for k in (1, 2)]
    tables.append_changes(change_frame(spark, rows[:-1]), source)
    loop = PollLoop(spark, jobs.table_configs(2), stored_tables(spark, source), f"{run}/polls", start_us=ZERO_US)
    loop.poll(0, ZERO_US + 600_000_000)
    assert loop.last_commit() == 0
    # The slower table has seen 00:02:30, less 30 seconds.
    assert loop.lowest_watermark() == ZERO_US + 120_000_000
    jobs.write_stage(spark, loop.records_path, run).awaitTermination()
    jobs.main(["publish", "--source", run, "--output", target])
    files = publish.published_files(spark, target).collect()
    assert sorted((r.path, r.rows) for r in files) == [
        (f"events_{k}/output-20240101-000{n}00-to-20240101-000{n + 1}00-00000-of-00001.json", 1)
        for k in (1, 2)
        for n in (0, 1)
    ]


def test_configs():
    configs = jobs.table_configs(2)
    assert [tuple(c) for c in configs] == [("events_1", 30), ("events_2", 30)]


def test_job_is_required():
    with pytest.raises(SystemExit):
        jobs.main([])


def test_feed_to_files(spark, tmp_path):
    """A change feed with columns of its own goes through to the JSON lines."""
    source, output = str(tmp_path / "tables"), str(tmp_path / "out")
    rows = [("INSERT", at("00:00:10"), 1, "a"), ("DELETE", at("00:01:10"), 2, "b")]
    feed = spark.createDataFrame(
        rows, "_CHANGE_TYPE string, _CHANGE_TIMESTAMP timestamp, item long, name string"
    )
    feed.write.parquet(tables.table_path(source, "feed"))
    config = [jobs.TableConfig("feed")]
    loop, schema = jobs._loop(
        spark, source, output, config, "Changes", lookback=False, start_us=ZERO_US
    )
    loop.poll(0, ZERO_US + 120_000_000)
    fields = ["change_type", "payload"]
    query = jobs.write_stage(spark, loop.records_path, output, fields, schema=schema)
    query.awaitTermination()
    lines = spark.read.parquet(f"{output}/raw").collect()
    assert sorted(r.value for r in lines) == [
        '{"change_type":"DELETE","payload":{"item":2,"name":"b"}}',
        '{"change_type":"INSERT","payload":{"item":1,"name":"a"}}',
    ]


def test_feeds_have_no_entities(spark, tmp_path):
    with pytest.raises(ValueError, match="change feed"):
        jobs.multi_table(
            spark, str(tmp_path), str(tmp_path), duplicate_key=jobs.ENTITY_KEY, mode="changes"
        )
    assert not jobs.is_feed("POLLING")
