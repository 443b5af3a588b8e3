"""Registered queries: every operator over the whole of the given tables.

Results are plain columns: positions as bigint microseconds, names and stamps as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.records import change_key_text, entity_key_text, json_line, to_records
from tidemark.functions.times import (
    iso_text,
    micros_text,
    micros_to_seconds,
    seconds_to_micros,
    text_to_micros,
    to_micros,
)
from tidemark.operators import duplicates, polls, replay, windows
from tidemark.operators.groups import attach_facts
from tidemark.plans import feeds, jobs
from tidemark.plans.backfill import Backfill
from tidemark.schema import FEED_TIMESTAMP, FEED_TYPE, TableConfig
from tidemark.session import shared_path, use_utc
from tidemark.sinks import ndjson, publish
from tidemark.sources import appends, scan, tables
from tidemark.streaming import duplicates as stream_duplicates
from tidemark.streaming import late, seen
from tidemark.streaming.poll_loop import PollLoop, each_table, stored_tables
from tidemark.streaming.windows import (
    run_available,
    stream_tables,
    stream_window_counts,
    write_record_files,
)

SECOND = 1_000_000
START = 1_704_067_200 * SECOND
STEP = 900 * SECOND
DAY = 86_400 * SECOND
FEED_START = 694_224_000 * SECOND

ORDER = "payload.order_id"
PRICE = "payload.price"


def _end(spark: SparkSession, sf_dir: str, *more: DataFrame) -> int:
    """The position behind the last change of `events` and of further change tables."""
    last = [
        t.agg(F.max(to_micros(F.col("change_timestamp")))).first()[0]
        for t in (feeds.changes(spark, sf_dir), *more)
    ]
    return max((us for us in last if us is not None), default=START) + 1


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_records(feeds.changes(spark, sf_dir))


def scan_poll_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = "2024-01-05 06:30:00", "2024-01-27 12:00:00.5"
    rows = scan.poll_scan(feeds.changes(spark, sf_dir), lo, hi)
    return scan.in_time_order(rows).select(
        "event_id", "change_type", ORDER, PRICE, to_micros(F.col("change_timestamp")).alias("us")
    )


def scan_poll_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.poll_scan_micros(feeds.changes(spark, sf_dir), START + DAY, START + 29 * DAY)
    us = to_micros(F.col("change_timestamp"))
    return rows.select(
        ORDER,
        us.alias("us"),
        micros_to_seconds(us).alias("seconds"),
        seconds_to_micros(micros_to_seconds(us)).alias("back_us"),
        micros_text(us).alias("ts_text"),
    )


def lookback_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.lookback_scan(
        feeds.changes(spark, sf_dir), START + 4 * DAY + 1, START + 2 * DAY, START + 28 * DAY
    )
    return to_records(rows, "events", START + 4 * DAY + 1).select(
        "event_id", ORDER, "us", "is_late"
    )


def change_feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.order_feed(spark, sf_dir)
    rows = scan.change_feed_scan(feed, 820_454_400 * SECOND, 978_307_200 * SECOND)
    return rows.select(
        "change_type",
        to_micros(F.col("change_timestamp")).alias("us"),
        "payload.o_orderkey",
        "payload.o_custkey",
        "payload.o_totalprice",
        "payload.o_orderpriority",
    )


def multi_table_fanin(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {
        "events": feeds.changes(spark, sf_dir),
        "orders": feeds.order_changes(spark, sf_dir),
        "lineitem": feeds.line_changes(spark, sf_dir),
    }
    hi = _end(spark, sf_dir, sources["orders"], sources["lineitem"])
    merged = scan.fan_in({n: scan.poll_scan_micros(t, 0, hi) for n, t in sources.items()})
    return merged.select(
        "table_name",
        "event_id",
        "change_type",
        ORDER,
        PRICE,
        to_micros(F.col("change_timestamp")).alias("us"),
    )


def record_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    hi = _end(spark, sf_dir, feeds.order_changes(spark, sf_dir))
    feed = scan.change_feed_scan(feeds.order_feed(spark, sf_dir), 0, hi)
    keys = ["event_id", "change_type", "change_timestamp", "table_name", "is_late", "is_duplicate"]
    from_feed = to_records(feed, "orders").select(
        *keys, F.col("payload.o_orderkey").cast("string").alias("payload_text")
    )
    bare = feeds.changes(spark, sf_dir).select("event_id", "change_timestamp", "table_name")
    from_bare = to_records(bare).select(*keys, F.to_json("payload").alias("payload_text"))
    return from_feed.unionByName(from_bare)


def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = feeds.changes(spark, sf_dir).select(ORDER, "change_timestamp").unionByName(
        feeds.order_changes(spark, sf_dir).select(
            F.concat(F.lit("orders-"), "event_id").alias("order_id"), "change_timestamp"
        )
    )
    ts = F.col("change_timestamp")
    text = micros_text(to_micros(ts))
    return stamps.select(
        "order_id",
        iso_text(ts).alias("iso"),
        text.alias("ts_text"),
        text_to_micros(text).alias("back_us"),
    )


def poll_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls with lookback: one that only reads rows again stays at its own start."""
    known = _progress(spark, sf_dir)
    own = known.select("table_name", "poll", "start_us")
    quiet = known.select(
        "table_name", (F.col("poll") + 1).alias("poll"), F.col("next_start_us").alias("start_us")
    ).join(own.select("table_name", "poll"), ["table_name", "poll"], "left_anti")
    starts = own.unionByName(quiet)
    return polls.poll_progress(_lookback(spark, sf_dir).join(starts, ["table_name", "poll"]))


def contiguous_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replay.contiguous_replay(feeds.delayed_changes(spark, sf_dir), START, STEP, "arrival_us")
    return rows.select("table_name", ORDER, "us", "poll", "poll_lo_us", "poll_hi_us")


def contiguous_replay_on_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row, seen at its own time."""
    rows = replay.contiguous_replay(feeds.changes(spark, sf_dir), START, STEP)
    return rows.select("table_name", ORDER, "us", "poll", "poll_lo_us", "poll_hi_us")


def _lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.lookback_replay(feeds.changes(spark, sf_dir), START, STEP)


def lookback_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookback(spark, sf_dir).select(
        "table_name", "event_id", ORDER, "us", "poll", "is_late"
    )


def lookback_replay_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replay.delayed_replay(feeds.delayed_changes(spark, sf_dir), START, STEP, "arrival_us")
    return rows.select("table_name", "event_id", ORDER, "us", "arrival_us", "poll", "is_late")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls.poll_facts(polls.with_poll(feeds.changes(spark, sf_dir), START, STEP))


def _delayed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = feeds.delayed_changes(spark, sf_dir)
    return polls.poll_facts(polls.with_poll(changes, START, STEP, "arrival_us"))


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.lookback_progress(_facts(spark, sf_dir), START, STEP)


def progress_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.progress_audit(_progress(spark, sf_dir))


def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.backlog(_progress(spark, sf_dir), _end(spark, sf_dir)).select(
        "table_name", "poll", "backlog_us", "fraction_done"
    )


def due_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Tables with an even number are polled half as often.
    interval = F.when(F.col("table_name").isin("events_2", "events_4"), 2).otherwise(1) * STEP
    state = _progress(spark, sf_dir).select(
        "table_name",
        "poll",
        F.col("next_start_us").alias("start_us"),
        (F.col("target_us") + interval).alias("next_due_us"),
        (F.col("target_us") + STEP).alias("now_us"),
    )
    return polls.due_tables(state, F.col("now_us"))


def range_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = feeds.changes(spark, sf_dir)
    size = 100_000 * SECOND
    ranges = changes.groupBy("table_name").agg(
        F.min("us").alias("lo_us"),
        (F.max("us") + 1).alias("hi_us"),
        F.count(F.lit(1)).alias("rows"),
    )
    located = attach_facts(changes.select("table_name", "us"), ranges, ["table_name"], "rows")
    index = polls.chunk_index(F.col("us"), F.col("lo_us"), F.col("hi_us"), size)
    counts = located.groupBy("table_name", index.alias("chunk")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    chunks = polls.range_chunks(ranges.drop("rows"), size)
    return chunks.join(counts, ["table_name", "chunk"], "left").withColumn(
        "rows", F.coalesce("rows", F.lit(0).cast("long"))
    )


def dup_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.changes(spark, sf_dir).select("table_name", "event_id", ORDER, "us")
    flagged = duplicates.flag_duplicates(rows, row_id=["order_id"])
    return flagged.withColumn("entity_key", entity_key_text())


def dup_flag_change_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lookback(spark, sf_dir).select(*duplicates.CHANGE_KEY, ORDER, "us", "poll", "is_late")
    flagged = duplicates.flag_duplicates(
        rows, duplicates.CHANGE_KEY, order_by=["poll"], row_id=["order_id"]
    )
    return flagged.drop("change_timestamp")


def dup_flag_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without identity: all changes of a user on a day look the same."""
    day = F.col("us") - F.col("us") % DAY
    rows = feeds.changes(spark, sf_dir).select("table_name", "event_id", day.alias("us"))
    return duplicates.flag_duplicates(rows)


def dedup_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = iso_text(F.col("change_timestamp"))
    rows = _lookback(spark, sf_dir).withColumn("change_timestamp", stamp)
    keyed = rows.select(change_key_text().alias("change_key"), ORDER, "poll", "is_late")
    return duplicates.drop_duplicates(keyed, ["change_key"], ["poll"])


def tumbling_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_counts(_records(spark, sf_dir))


def tumbling_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = to_records(_lookback(spark, sf_dir))
    return windows.window_counts(late, seconds=3600)


def watermark_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls.watermark_single(_delayed_facts(spark, sf_dir), START)


def watermark_lag30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls.watermark_multi(_delayed_facts(spark, sf_dir), START)


def idle_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = polls.poll_calendar(_delayed_facts(spark, sf_dir))
    marks = calendar
    for name, timeout in (("at_once", 0), ("never", None), ("one_hour", 3600 * SECOND)):
        marks = polls.idle_watermarks(marks, START, STEP, idle_timeout_us=timeout)
        marks = marks.withColumnRenamed("watermark_us", f"{name}_us")
    return marks.select("table_name", "poll", "at_once_us", "never_us", "one_hour_us")


def min_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = polls.poll_calendar(_delayed_facts(spark, sf_dir))
    marks = polls.idle_watermarks(calendar, START, STEP, 30, 0, None)
    return polls.slowest_watermark(marks)


def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = feeds.delayed_changes(spark, sf_dir).select("table_name", "us", "arrival_us")
    polled = polls.with_poll(changes, START, STEP, "arrival_us")
    judged = windows.late_drop(polled, START, 30, seconds=3600)
    start = F.col("us") - F.col("us") % (3600 * SECOND)
    return judged.groupBy("table_name", start.alias("win_start_us")).agg(
        F.count_if(~F.col("is_dropped")).alias("kept_rows"),
        F.count_if("is_dropped").alias("dropped_rows"),
    )


def ndjson_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return records.select(ORDER, json_line(records).alias("line"))


def single_table_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned rows of one table, written as JSON lines and read back."""
    rows = scan.poll_scan_micros(feeds.changes(spark, sf_dir), START, _end(spark, sf_dir))
    path = shared_path(spark, "single")
    ndjson.write_lines(rows, path, rows.columns)
    return spark.read.text(path).withColumnRenamed("value", "line")


def window_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    name = ndjson.output_name(
        windows.tumbling("event_time"), F.lit(0), F.lit(1), F.col("table_name")
    )
    return records.groupBy(name.alias("path")).agg(F.count(F.lit(1)).alias("rows"))


def _written(spark: SparkSession, path: str) -> DataFrame:
    return (
        ndjson.read_windows(spark, path)
        .groupBy("dest", "win", "_metadata.file_path")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("dest", "win")
        .agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"))
    )


def one_file_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "windows")
    placed = windows.with_destination(_records(spark, sf_dir))
    ndjson.write_windows(placed, path)
    return _written(spark, path)


def compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ndjson.placed_lines(_records(spark, sf_dir))
    source, target = shared_path(spark, "raw"), shared_path(spark, "compacted")
    publish.write_raw(lines, source)
    publish.publish_windows(spark, source, target, closed_before="20240121-000000")
    return (
        publish.read_published(spark, target)
        .groupBy("dest", "win", "path")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("dest", "win")
        .agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"))
    )


def _change_tables(spark: SparkSession, sf_dir: str) -> str:
    root = shared_path(spark, "tables")
    tables.create_tables(spark, root, feeds.TABLES)
    tables.append_changes(feeds.changes(spark, sf_dir), root)
    return root


def append_change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _change_tables(spark, sf_dir)
    lo, hi = START, _end(spark, sf_dir)
    stored = scan.fan_in(
        {
            name: scan.poll_scan_micros(tables.read_table(spark, root, name, lo, hi), lo, hi)
            for name in feeds.TABLES
        }
    )
    return stored.select(
        "table_name",
        "event_id",
        "change_type",
        ORDER,
        PRICE,
        to_micros(F.col("change_timestamp")).alias("us"),
    )


def stream_dup_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = feeds.as_changes(feeds.stream(spark, sf_dir, "events"))
    narrow = changes.select("table_name", "event_id", ORDER, "us")
    path = shared_path(spark, "stream-dup")
    seen.flag_stream(narrow, path).awaitTermination()
    return spark.read.parquet(f"{path}/rows").drop("batch")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = feeds.as_changes(feeds.stream(spark, sf_dir, "events"))
    keyed = changes.select("table_name", "event_id", "us", "change_timestamp").withWatermark(
        "change_timestamp", "31 days"
    )
    kept = stream_duplicates.drop_duplicates(keyed, ["table_name", "event_id"], "us")
    return run_available(kept, "stream-dedup").select("table_name", "event_id")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _change_tables(spark, sf_dir)
    # A later row in each table closes all windows before it; its own window stays open.
    last = feeds.changes(spark, sf_dir).groupBy("table_name").agg(F.max_by("payload", "us").alias("payload"))
    closing = F.timestamp_micros(F.lit(_end(spark, sf_dir) + 2 * 3600 * SECOND))
    tables.append_changes(
        last.withColumns({"event_id": F.lit("end"), "change_type": F.lit("UPDATE"), "change_timestamp": closing}), root
    )
    merged = stream_tables(spark, root, feeds.TABLES, "30 seconds")
    return run_available(stream_window_counts(merged, seconds=3600), "stream-windows")


def stream_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = feeds.as_changes(feeds.stream(spark, sf_dir, "events"))
    path = shared_path(spark, "stream-files")
    query = write_record_files(to_records(changes), f"{path}/out", f"{path}/checkpoint")
    query.awaitTermination()
    return ndjson.read_windows(spark, f"{path}/out").groupBy("dest", "win").agg(
        F.count(F.lit(1)).alias("rows")
    )


def _poll_loop(
    spark: SparkSession, sf_dir: str, lookback: bool, path: str
) -> tuple[PollLoop, list[int]]:
    """Polls every five days, until two quiet polls after the last row, and the times at which they happen."""
    root = _change_tables(spark, sf_dir)
    step = 5 * DAY
    loop = PollLoop(
        spark,
        [TableConfig(name, poll_interval=5 * 86_400) for name in feeds.TABLES],
        stored_tables(spark, root),
        path,
        lookback=lookback,
        start_us=START,
    )
    polls_made = (_end(spark, sf_dir) - 1 - START) // step + 3
    return loop, [START + (batch_id + 1) * step for batch_id in range(polls_made)]


def _poll_on(spark: SparkSession, sf_dir: str, lookback: bool) -> PollLoop:
    loop, ends = _poll_loop(spark, sf_dir, lookback, shared_path(spark, "polls"))
    for batch_id, now in enumerate(ends):
        loop.poll(batch_id, now)
    return loop


def live_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    poll = F.col("batch_id").cast("long").alias("poll")
    return _poll_on(spark, sf_dir, lookback=True).records().select(
        "table_name", "event_id", ORDER, "us", poll, "is_late"
    )


def published_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls every five days; the windows that a commit has closed become files, re-read rows join them later."""
    output = shared_path(spark, "published")
    loop, ends = _poll_loop(spark, sf_dir, True, f"{output}/polls")
    for batch_id, now in enumerate(ends):
        loop.poll(batch_id, now)
        rows = loop.records().where(F.col("batch_id") == batch_id).drop("batch_id")
        publish.write_raw(ndjson.placed_lines(rows, seconds=3600), f"{output}/raw")
        if batch_id % 3 == 2 or now == ends[-1]:
            jobs.publish_closed(loop, output)
    return (
        publish.read_published(spark, f"{output}/files")
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def commit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of live polls, with two false ones: a claim that is a second too low, and a row too many."""
    loop = _poll_on(spark, sf_dir, lookback=True)
    here = lambda table, poll: (F.col("table_name") == table) & (F.col("batch_id") == poll)
    commits = loop.progress().withColumns(
        {
            "next_start": F.when(here("events_3", 2), F.col("next_start") - SECOND).otherwise(F.col("next_start")),
            "rows": F.when(here("events_2", 3), F.col("rows") + 1).otherwise(F.col("rows")),
        }
    )
    return replay.commit_audit(commits, loop.records())


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour over changes that arrive up to nine days late, five days a batch.

    Rows of `step` NULL are closed windows with what was kept; the others say how many windows came too late in a batch.
    """
    changes = feeds.changes(spark, sf_dir)
    number = F.substring(F.col(ORDER), 3, 20).cast("long")
    arrival = F.col("us") + number * 7919 % 10 * DAY
    arrivals = changes.select(
        "table_name", "change_timestamp", F.call_function("div", arrival - START, F.lit(5 * DAY)).alias("step")
    )
    # Two later rows close all windows: one moves the watermark, the next one shows it to the windows.
    close = F.timestamp_micros(F.lit(_end(spark, sf_dir) + 40 * DAY))
    for step in (1_000, 1_001):
        arrivals = arrivals.unionByName(
            spark.range(1).select(F.lit("closing").alias("table_name"), close.alias("change_timestamp"), F.lit(step).cast("long").alias("step"))
        )
    kept, dropped = late.replay_arrivals(arrivals, shared_path(spark, "late"), "30 seconds", 3600)
    none = F.lit(None).cast("long")
    return kept.select("table_name", "win_start_us", "rows", none.alias("step")).unionByName(
        dropped.where(F.col("step") < 1_000).select(
            F.lit("dropped").alias("table_name"), none.alias("win_start_us"), F.col("dropped_groups").alias("rows"), "step"
        )
    )


def append_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes as JSON lines, some of them broken, appended by a stream: rows stored and rejected, by reason."""
    root, path = shared_path(spark, "tables"), shared_path(spark, "lines")
    tables.create_tables(spark, root, feeds.TABLES)
    changes = feeds.changes(spark, sf_dir)
    number = F.substring(F.col(ORDER), 3, 20).cast("long")
    whole = F.to_json(F.struct("event_id", "change_type", "payload", "change_timestamp"))
    untimed = F.to_json(F.struct("event_id", "change_type", "payload"))
    line = F.when(number % 97 == 0, F.substring(whole, 1, 40)).when(number % 89 == 0, untimed).otherwise(whole)
    table = F.when(number % 83 == 0, "events_9").otherwise(F.col("table_name"))
    changes.select(line.alias("value"), table.alias("table_name")).write.partitionBy("table_name").text(path)
    appends.append_stream(appends.stream_lines(spark, path), root, f"{path}-checkpoint").awaitTermination()
    stored = tables.scan_tables(spark, root, [(name, START, _end(spark, sf_dir)) for name in feeds.TABLES])
    stored = stored.select("table_name", F.lit(appends.STORED).alias("outcome"))
    rejected = appends.rejected_lines(spark, root).select("table_name", F.col("reason").alias("outcome"))
    return stored.unionByName(rejected).groupBy("table_name", "outcome").agg(F.count(F.lit(1)).alias("rows"))


def backfill_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill that breaks off in its third group, after the group's rows were written, and is gone on with."""
    root, path = _change_tables(spark, sf_dir), shared_path(spark, "backfill")
    ranges = [(name, START, _end(spark, sf_dir)) for name in feeds.TABLES]

    def job() -> Backfill:
        return Backfill(spark, stored_tables(spark, root), path, ranges, 100_000 * SECOND, chunks_at_once=5)

    first = job()
    first.run(most=2)
    first.scan([(name, START, START + DAY) for name in feeds.TABLES]).write.parquet(f"{path}/rows/part=2")
    second = job()
    second.run()
    return second.rows().groupBy("table_name", "chunk").agg(F.count(F.lit(1)).alias("rows"))


def live_poll_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _poll_on(spark, sf_dir, lookback=False).progress().select(
        F.col("batch_id").alias("poll"),
        "table_name",
        F.col("start").alias("start_us"),
        F.col("target").alias("target_us"),
        "rows",
        F.col("watermark").alias("watermark_us"),
    )


def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as a change feed, polled a year at a time."""
    step = 365 * DAY
    feed = feeds.order_feed(spark, sf_dir)
    last = feed.agg(F.max(to_micros(F.col(FEED_TIMESTAMP)))).first()[0] or FEED_START
    loop = PollLoop(
        spark,
        [TableConfig("orders", poll_interval=365 * 86_400)],
        each_table(lambda name, lo, hi: feed, "changes"),
        shared_path(spark, "feed-polls"),
        lookback=False,
        start_us=FEED_START,
    )
    for batch_id in range((last - FEED_START) // step + 1):
        loop.poll(batch_id, FEED_START + (batch_id + 1) * step)
    return loop.records().select(
        "table_name",
        "event_id",
        "change_type",
        "payload.o_orderkey",
        "us",
        F.col("batch_id").cast("long").alias("poll"),
    )


def stored_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a change feed stored by day, with columns of its own, polled every five days."""
    source, step = shared_path(spark, "feeds"), 5 * DAY
    events = feeds.load(spark, sf_dir, "events")
    feed = events.select(
        F.upper("event_type").alias(FEED_TYPE),
        F.col("ts").cast("timestamp").alias(FEED_TIMESTAMP),
        F.col("event_id").alias("number"),
        "value",
    )
    tables.write_feed(feed, source, "events")
    loop = PollLoop(
        spark,
        [TableConfig("events", poll_interval=5 * 86_400)],
        each_table(tables.StoredFeeds(spark, source).read, "changes"),
        shared_path(spark, "feed-polls"),
        lookback=False,
        start_us=START,
    )
    for batch_id in range((_end(spark, sf_dir) - 1 - START) // step + 1):
        loop.poll(batch_id, START + (batch_id + 1) * step)
    return loop.records().select(
        "table_name", "change_type", "payload.number", "us", F.col("batch_id").cast("long").alias("poll")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_poll_window,
        scan_poll_micros,
        lookback_scan,
        change_feed_scan,
        multi_table_fanin,
        record_defaults,
        iso_timestamps,
        poll_progress,
        contiguous_replay,
        contiguous_replay_on_time,
        lookback_replay,
        lookback_replay_delayed,
        progress_audit,
        backlog,
        due_tables,
        range_chunks,
        dup_flag,
        dup_flag_change_key,
        dup_flag_copies,
        dedup_distinct,
        tumbling_60s,
        tumbling_1h,
        watermark_single,
        watermark_lag30,
        idle_watermark,
        min_watermark,
        late_drop,
        ndjson_text,
        single_table_output,
        window_paths,
        one_file_per_window,
        compact_windows,
        append_change_rows,
        stream_dup_flag,
        stream_dedup,
        stream_tumbling,
        stream_record_files,
        live_poll,
        published_windows,
        commit_audit,
        stream_late,
        append_rejects,
        backfill_chunks,
        live_poll_progress,
        live_feed,
        stored_feed,
    )
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries; each pins the session to UTC before it is built."""

    def pinned(query):
        return lambda spark, sf_dir: query(use_utc(spark), sf_dir.rstrip("/"))

    return {name: pinned(query) for name, query in QUERIES.items()}
