"""The two live jobs: one table in contiguous polls, and many tables with lookback.

    python -m tidemark.plans.jobs multi --run-id 7 --tables 2 \\
        --source /shared/tables --output /shared/out

Each job runs three streaming queries that can be stopped and started again at any time: the poll
loop writes records, a second query adds them as JSON lines to a raw store, and a third one publishes each
window that the watermark has closed as a file with its name. `publish` does the last step once.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.functions.records import to_records
from tidemark.functions.times import micros_window_text
from tidemark.operators.duplicates import CHANGE_KEY, ENTITY_KEY, check_key
from tidemark.schema import CHANGE_COLUMNS, POLL_INTERVAL_SECONDS, WINDOW_SECONDS, TableConfig
from tidemark.session import build_session, folder_exists
from tidemark.sinks.ndjson import placed_lines
from tidemark.sinks.publish import publish_windows, stream_raw
from tidemark.sources.tables import StoredFeeds, create_tables
from tidemark.streaming.poll_loop import PollLoop, each_table, stored_tables
from tidemark.streaming.records import RECORD_DDL, create_records, stream_records
from tidemark.streaming.seen import flag_stream

TABLE_PREFIX = "events"
POLLING = "polling"
KEYS = {"entity": ENTITY_KEY, "change": CHANGE_KEY}


def table_configs(count: int, poll_interval: int = POLL_INTERVAL_SECONDS) -> list[TableConfig]:
    """`events_1` … `events_<count>`."""
    return [TableConfig(f"{TABLE_PREFIX}_{n}", poll_interval) for n in range(1, count + 1)]


def is_feed(mode: str) -> bool:
    """`polling` in any case reads change tables, anything else change feeds."""
    return mode.lower() != POLLING


def _loop(
    spark: SparkSession,
    source: str,
    output: str,
    tables: list[TableConfig],
    mode: str = POLLING,
    **options,
) -> tuple[PollLoop, T.StructType]:
    """The poll loop and the schema of its records, whose payload a feed brings along."""
    if is_feed(mode):
        scan = each_table(StoredFeeds(spark, source).read, mode)
        nothing = scan([(t.table_name, 0, 0) for t in tables])
        schema = to_records(nothing, start_us=0).schema
    else:
        scan = stored_tables(spark, source)
        schema = T.StructType.fromDDL(RECORD_DDL)
    loop = PollLoop(spark, tables, scan, f"{output}/polls", **options)
    create_records(spark, loop.records_path, schema)
    return loop, schema


def write_stage(
    spark: SparkSession,
    records_path: str,
    output: str,
    fields: list[str] | None = None,
    duplicate_key: list[str] | None = None,
    seconds: int = WINDOW_SECONDS,
    trigger: dict | None = None,
    schema: str | T.StructType = RECORD_DDL,
) -> StreamingQuery:
    """Start the query from records to raw lines by window; with a key, another one before it flags duplicates."""
    records = stream_records(spark, records_path, schema)
    if duplicate_key:
        flagged = f"{output}/flagged"
        columns = [f for f in records.schema.fields if f.name != "is_duplicate"]
        schema = T.StructType([*columns, T.StructField("is_duplicate", T.BooleanType())])
        create_records(spark, f"{flagged}/rows", schema)
        flagging = flag_stream(records, flagged, duplicate_key, trigger=trigger)
        if not trigger:
            flagging.awaitTermination()
        records = stream_records(spark, f"{flagged}/rows", schema)
    lines = placed_lines(records, seconds=seconds, fields=fields)
    return stream_raw(lines, f"{output}/raw", f"{output}/raw-checkpoint", trigger)


def publish_closed(loop: PollLoop, output: str, target: str | None = None) -> DataFrame | None:
    """Publish the windows that the newest commit has closed, from `<output>/raw` to `<output>/files`.

    A window is closed when the watermark of the slowest table has reached its end. Rows that come later are added
    to the window's file by the next run. Returns the files of the run; None before the first commit.
    """
    mark = loop.lowest_watermark()
    if mark is None or not folder_exists(loop.spark, f"{output}/raw"):
        return None
    return publish_windows(loop.spark, f"{output}/raw", target or f"{output}/files", micros_window_text(mark))


def publish_stage(loop: PollLoop, output: str, seconds: int = WINDOW_SECONDS) -> StreamingQuery:
    """Publish closed windows again and again, on a stream of ticks."""
    ticks = loop.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def run(_: DataFrame, batch_id: int) -> None:
        publish_closed(loop, output)

    return (
        ticks.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{output}/files-checkpoint")
        .trigger(**_every(seconds))
        .start()
    )


def single_table(
    spark: SparkSession,
    source: str,
    output: str,
    table: str = TABLE_PREFIX,
    poll_interval: int = POLL_INTERVAL_SECONDS,
    start_us: int | None = None,
    mode: str = POLLING,
) -> PollLoop:
    """One change table, contiguous polls; the watermark follows the clock when it is quiet.

    The JSON lines hold the columns of the change table; a change feed has no event id.
    """
    config = [TableConfig(table, poll_interval)]
    loop, schema = _loop(
        spark, source, output, config, mode, lookback=False, start_us=start_us, idle_timeout=0
    )
    fields = [c for c in CHANGE_COLUMNS if not (is_feed(mode) and c == "event_id")]
    loop.start()
    write_stage(
        spark, loop.records_path, output, fields, trigger=_every(poll_interval), schema=schema
    )
    publish_stage(loop, output)
    return loop


def multi_table(
    spark: SparkSession,
    source: str,
    output: str,
    tables: int = 2,
    poll_interval: int = POLL_INTERVAL_SECONDS,
    start_us: int | None = None,
    duplicate_key: list[str] | None = None,
    mode: str = POLLING,
) -> PollLoop:
    """Many change tables or feeds with lookback polls, files by table and window.

    `duplicate_key` switches the duplicate flag on: `ENTITY_KEY` marks every later change of an entity,
    `CHANGE_KEY` only changes that were read again. Feeds have no entities.
    """
    if duplicate_key:
        check_key(duplicate_key, feed=is_feed(mode))
    configs = table_configs(tables, poll_interval)
    loop, schema = _loop(spark, source, output, configs, mode, start_us=start_us)
    loop.start()
    write_stage(
        spark,
        loop.records_path,
        output,
        duplicate_key=duplicate_key,
        trigger=_every(poll_interval),
        schema=schema,
    )
    publish_stage(loop, output)
    return loop


def _every(seconds: int) -> dict:
    return {"processingTime": f"{seconds} seconds"}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("create", "single", "multi", "publish"):
        job = jobs.add_parser(name)
        job.add_argument("--source", required=True, help="folder of tables, or of a run to publish")
        if name in ("create", "multi"):
            job.add_argument("--tables", type=int, required=True, help="number of tables")
        if name != "create":
            job.add_argument("--output", required=True)
        if name in ("single", "multi"):
            job.add_argument("--poll-interval", type=int, default=POLL_INTERVAL_SECONDS)
            job.add_argument("--start-us", type=int, help="replay from here instead of now")
            job.add_argument("--mode", default=POLLING, help="polling, or changes for feeds")
    jobs.choices["single"].add_argument("--table", default=TABLE_PREFIX)
    jobs.choices["multi"].add_argument("--run-id", required=True)
    jobs.choices["multi"].add_argument(
        "--duplicate-key", choices=sorted(KEYS), help="flag duplicates by this key"
    )
    args = parser.parse_args(argv)

    spark = build_session(f"tidemark-{getattr(args, 'run_id', args.job)}")
    if args.job == "create":
        create_tables(spark, args.source, [t.table_name for t in table_configs(args.tables)])
        return
    if args.job == "publish":
        publish_closed(PollLoop(spark, [], stored_tables(spark, ""), f"{args.source}/polls"), args.source, args.output)
        return
    common = {
        "poll_interval": args.poll_interval, "start_us": args.start_us, "mode": args.mode
    }
    if args.job == "single":
        single_table(spark, args.source, args.output, args.table, **common)
    else:
        key = KEYS.get(args.duplicate_key)
        output = f"{args.output}/{args.run_id}"
        multi_table(spark, args.source, output, args.tables, duplicate_key=key, **common)
    spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
