"""Windows, files and runs of streaming queries."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators.windows import tumbling
from tidemark.schema import WINDOW_SECONDS
from tidemark.session import plain_files, shared_path, write_tasks
from tidemark.sinks.ndjson import PLACE, placed_lines
from tidemark.sources.scan import union_all
from tidemark.sources.tables import stream_table


def union_streams(streams: list[DataFrame]) -> DataFrame:
    """One stream of many tables, each with the watermark it came with."""
    return union_all(streams)


def stream_tables(
    spark: SparkSession, root: str, table_names: list[str], delay: str, **options: int
) -> DataFrame:
    """All change tables as one stream whose watermark is that of the slowest table."""
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    return union_streams(
        [stream_table(spark, root, name, delay, **options) for name in table_names]
    )


def stream_window_counts(
    stream: DataFrame, event_time: str = "change_timestamp", seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """Rows per table and closed window. Late rows are dropped and counted in the progress."""
    us = F.unix_micros(event_time)
    return (
        stream.groupBy("table_name", tumbling(event_time, seconds).alias("window"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(us).alias("min_us"),
            F.max(us).alias("max_us"),
        )
        .select(
            "table_name",
            F.unix_micros("window.start").alias("win_start_us"),
            F.unix_micros("window.end").alias("win_end_us"),
            "rows",
            "min_us",
            "max_us",
        )
    )


def write_record_files(
    records: DataFrame,
    path: str,
    checkpoint: str,
    event_time: str = "event_time",
    seconds: int = WINDOW_SECONDS,
    fields: list[str] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Records as JSON lines by table and window, late ones included, each exactly once.

    Every micro-batch adds its own files to a window; `publish_windows` merges them later. Opening a file costs
    far more than a row does, so the windows of each input task are dealt over all tasks; files become neither
    more nor larger by that.
    """
    lines = placed_lines(records, event_time, seconds, fields)
    # The task number is the same when a task is run again.
    dealt = lines.withColumn("_task", F.spark_partition_id()).repartition(
        write_tasks(records.sparkSession), *PLACE, "_task"
    )
    writer = (
        dealt.select(*lines.columns).writeStream.format("text")
        .partitionBy(*PLACE)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
    )
    with plain_files(records.sparkSession):
        return writer.start()


def stop_idle(query: StreamingQuery, timeout: float = 300) -> None:
    """Stop a query between two batches, so that none is cut off and repeated on the next start.

    After `timeout` seconds without a pause the query is stopped as it is, which is safe too.
    """
    end = time.monotonic() + timeout
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(0.2)
    query.stop()


def run_available(stream: DataFrame, label: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over everything there is, then read back what it wrote."""
    spark = stream.sparkSession
    path = shared_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", checkpoint or f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
