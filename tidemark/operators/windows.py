"""Tumbling windows of event time, and what lateness does to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import window_name
from tidemark.operators.groups import attach_facts
from tidemark.operators.polls import by_table, poll_facts
from tidemark.schema import WINDOW_SECONDS

SECOND = 1_000_000


def tumbling(event_time: Column | str, seconds: int = WINDOW_SECONDS) -> Column:
    """Window struct (`start`, `end`) of the event time."""
    return F.window(event_time, f"{seconds} seconds")


def window_counts(
    rows: DataFrame, event_time: str = "event_time", seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """Rows, late rows and range of positions per table and window.

    Counts are combined before the shuffle; rows are never gathered.
    """
    late = F.count_if("is_late") if "is_late" in rows.columns else F.lit(0).cast("long")
    return (
        rows.groupBy("table_name", tumbling(event_time, seconds).alias("window"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            late.alias("late_rows"),
            F.min("us").alias("min_us"),
            F.max("us").alias("max_us"),
        )
        .select(
            "table_name",
            F.unix_micros("window.start").alias("win_start_us"),
            F.unix_micros("window.end").alias("win_end_us"),
            "rows",
            "late_rows",
            "min_us",
            "max_us",
        )
    )


def with_destination(
    rows: DataFrame,
    event_time: str = "event_time",
    seconds: int = WINDOW_SECONDS,
    destination: Column | None = None,
) -> DataFrame:
    """Add `dest`, the output directory, and `win`, the window part of the output name."""
    return rows.withColumn(
        "dest", destination if destination is not None else F.col("table_name")
    ).withColumn("win", window_name(tumbling(event_time, seconds)))


def late_drop(
    polled: DataFrame,
    start_us: int,
    lag_seconds: int,
    seconds: int = WINDOW_SECONDS,
    polls_behind: int = 1,
    **attach: int,
) -> DataFrame:
    """Rows with `watermark_us` and `is_dropped`, as a windowed aggregate would treat them.

    `polled` has `table_name`, `poll` and `us`. A row is dropped if its window had already ended at
    the watermark the table had reached `polls_behind` polls with data earlier: 1 is the
    watermark before the poll, 2 is what a streaming query tests against.
    """
    reached = F.max(F.col("max_us") - lag_seconds * SECOND).over(
        by_table().rowsBetween(Window.unboundedPreceding, -polls_behind)
    )
    before = poll_facts(polled).select(
        "table_name",
        "poll",
        "rows",
        F.greatest(reached, F.lit(start_us)).alias("watermark_us"),
    )
    known = attach_facts(polled, before, ["table_name", "poll"], "rows", **attach)
    size = seconds * SECOND
    end = F.col("us") - F.pmod(F.col("us"), F.lit(size)) + size
    return known.select(
        *polled.columns, "watermark_us", (end <= F.col("watermark_us")).alias("is_dropped")
    )
