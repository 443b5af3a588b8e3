"""Scans of change tables over a half-open range of change time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import midpoint
from tidemark.schema import CHANGE_COLUMNS, FEED_TIMESTAMP, FEED_TYPE, PARTITION_DAY


def _in_range(table: DataFrame, column: str, lo: Column, hi: Column) -> DataFrame:
    """`lo <= column < hi`. NULL timestamps fall out. Prunes day partitions where there are any."""
    ts = F.col(column).cast("timestamp")
    kept = table.filter((ts >= lo) & (ts < hi))
    if PARTITION_DAY in table.columns:
        kept = kept.filter(F.col(PARTITION_DAY).between(F.to_date(lo), F.to_date(hi)))
    return kept


def poll_scan(table: DataFrame, lo: str, hi: str) -> DataFrame:
    """The change columns of one table with `lo <= change_timestamp < hi`, bounds as text."""
    lo_ts, hi_ts = F.to_timestamp(F.lit(lo)), F.to_timestamp(F.lit(hi))
    return _in_range(table, "change_timestamp", lo_ts, hi_ts).select(*_change_columns(table))


def poll_scan_micros(table: DataFrame, lo_us: int, hi_us: int) -> DataFrame:
    """As `poll_scan`, bounds as microseconds."""
    lo, hi = F.timestamp_micros(F.lit(lo_us)), F.timestamp_micros(F.lit(hi_us))
    return _in_range(table, "change_timestamp", lo, hi).select(*_change_columns(table))


def lookback_scan(table: DataFrame, start_us: int, prev_start_us: int, target_us: int) -> DataFrame:
    """Reads from the middle between this start and the previous one, up to `target_us`."""
    return poll_scan_micros(table, (start_us + prev_start_us) // 2, target_us)


def lookback_floor(start: Column, prev_start: Column) -> Column:
    """Column form of the lower bound of `lookback_scan`."""
    return midpoint(start, prev_start)


def change_feed_scan(feed: DataFrame, lo_us: int, hi_us: int) -> DataFrame:
    """Rows of a change feed: metadata columns renamed, all others packed into `payload`.

    The feed has no `event_id`, so none is produced.
    """
    lo, hi = F.timestamp_micros(F.lit(lo_us)), F.timestamp_micros(F.lit(hi_us))
    payload = [c for c in feed.columns if c not in (FEED_TYPE, FEED_TIMESTAMP, PARTITION_DAY)]
    return _in_range(feed, FEED_TIMESTAMP, lo, hi).select(
        F.col(FEED_TYPE).alias("change_type"),
        F.col(FEED_TIMESTAMP).cast("timestamp").alias("change_timestamp"),
        F.struct(*payload).alias("payload"),
    )


def fan_in(scans: Mapping[str, DataFrame]) -> DataFrame:
    """One stream of changes out of many tables, each row tagged with its `table_name`."""
    return union_all([df.withColumn("table_name", F.lit(name)) for name, df in scans.items()])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by halves: each frame is looked at again only as often as the halving goes on."""
    while len(frames) > 1:
        pairs = zip(frames[::2], [*frames[1::2], None])
        frames = [a if b is None else a.unionByName(b) for a, b in pairs]
    return frames[0]


def in_time_order(changes: DataFrame) -> DataFrame:
    """Sort by change time. Rows with the same time are spread over tasks by where they come from."""
    return (
        changes.withColumn("_task", F.spark_partition_id())
        .orderBy("change_timestamp", "_task")
        .drop("_task")
    )


def _change_columns(table: DataFrame) -> list[str]:
    return [c for c in CHANGE_COLUMNS if c in table.columns]
