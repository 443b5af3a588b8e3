"""Facts about polls: what each poll of a table picks up, and how far it gets.

Frames of change rows carry `table_name` and `us`, the position of the change. A poll `k` at a
fixed cadence covers `[start + k * step, start + (k + 1) * step)`. Poll facts have one row per
table and poll, so their number depends on the time covered and not on the number of changes;
windows over them are therefore safe where windows over changes would not be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.times import poll_index
from tidemark.schema import INITIAL_WATERMARK_LAG_SECONDS, WATERMARK_LAG_SECONDS

SECOND = 1_000_000


def by_table() -> WindowSpec:
    return Window.partitionBy("table_name").orderBy("poll")


def with_poll(
    changes: DataFrame, start_us: int, step_us: int, arrival: str | None = None
) -> DataFrame:
    """Add `poll`, the first poll that can see the row; rows before the start are left out.

    A row is seen once it has arrived and its own time has passed.
    """
    seen = F.greatest(F.col(arrival), F.col("us")) if arrival else F.col("us")
    return changes.filter(F.col("us") >= start_us).withColumn(
        "poll", poll_index(seen, start_us, step_us)
    )


def poll_facts(polled: DataFrame) -> DataFrame:
    """Rows and largest position per table and poll."""
    return polled.groupBy("table_name", "poll").agg(
        F.max("us").alias("max_us"), F.count(F.lit(1)).alias("rows")
    )


def poll_progress(scanned: DataFrame, start: str = "start_us") -> DataFrame:
    """Per table: rows read and position reached, which is never below the poll's start."""
    return scanned.groupBy("table_name", start).agg(
        F.count(F.lit(1)).alias("rows"),
        F.greatest(F.max("us"), F.col(start)).alias("reached_us"),
    )


def poll_calendar(facts: DataFrame, last_poll: int | None = None) -> DataFrame:
    """`facts` with a row for every poll of every table, quiet polls included (NULL facts).

    Runs to `last_poll`, or to the last poll in which any table has rows.
    """
    tables = facts.groupBy("table_name").agg(F.max("poll").alias("_last"))
    if last_poll is None:
        # One number; a window over all tables would gather them in one task.
        tables = tables.withColumn("_last", F.lit(tables.agg(F.max("_last")).first()[0]).cast("long"))
    else:
        tables = tables.withColumn("_last", F.lit(last_poll).cast("long"))
    polls = tables.select(
        "table_name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("poll")
    )
    return polls.join(facts, ["table_name", "poll"], "left")


def _running_max(value: Column) -> Column:
    return F.max(value).over(by_table().rowsBetween(Window.unboundedPreceding, 0))


def watermarks(
    facts: DataFrame, start_us: int, lag_seconds: int, initial_lag_seconds: int = 0
) -> DataFrame:
    """Watermark after each poll: largest position seen so far minus the lag, never falling."""
    floor = F.lit(start_us - initial_lag_seconds * SECOND)
    return facts.withColumn(
        "watermark_us",
        F.greatest(_running_max(F.col("max_us") - lag_seconds * SECOND), floor),
    )


def watermark_single(facts: DataFrame, start_us: int) -> DataFrame:
    """No lag; begins five minutes before the start."""
    return watermarks(facts, start_us, 0, INITIAL_WATERMARK_LAG_SECONDS)


def watermark_multi(facts: DataFrame, start_us: int) -> DataFrame:
    """Lag of 30 seconds; begins at the start."""
    return watermarks(facts, start_us, WATERMARK_LAG_SECONDS, 0)


def idle_watermarks(
    calendar: DataFrame,
    start_us: int,
    step_us: int,
    lag_seconds: int = 0,
    initial_lag_seconds: int = INITIAL_WATERMARK_LAG_SECONDS,
    idle_timeout_us: int | None = 0,
) -> DataFrame:
    """Watermark after every poll of a calendar, quiet ones included.

    A quiet poll moves the watermark to its end once the table has been quiet for
    `idle_timeout_us` (0: at once; None: never).
    """
    end = F.lit(start_us) + (F.col("poll") + 1) * step_us
    moved = F.col("max_us") - lag_seconds * SECOND
    if idle_timeout_us is not None:
        last_end = F.coalesce(
            _running_max(F.when(F.col("max_us").isNotNull(), end)), F.lit(start_us)
        )
        idle = F.col("max_us").isNull() & (end - F.col("_active_us") >= idle_timeout_us)
        calendar = calendar.withColumn("_active_us", last_end)
        moved = F.when(idle, end).otherwise(moved)
    floor = F.lit(start_us - initial_lag_seconds * SECOND)
    return (
        calendar.withColumn("_moved", moved)
        .withColumn("watermark_us", F.greatest(_running_max(F.col("_moved")), floor))
        .drop("_moved", "_active_us")
    )


def slowest_watermark(per_table: DataFrame) -> DataFrame:
    """Watermark of the union of all tables: the slowest table holds it back."""
    return per_table.groupBy("poll").agg(
        F.min("watermark_us").alias("watermark_us"), F.count(F.lit(1)).alias("tables")
    )


def due_tables(state: DataFrame, now_us: int | Column) -> DataFrame:
    """Tables whose time to poll has come and that are not caught up with `now_us`.

    `state` has `start_us` and `next_due_us` per table.
    """
    now = now_us if isinstance(now_us, Column) else F.lit(now_us)
    return state.filter((F.col("next_due_us") <= now) & (F.col("start_us") < now))


def range_chunks(ranges: DataFrame, size_us: int, min_us: int = 1) -> DataFrame:
    """Cut `[lo_us, hi_us)` of each row of `ranges` into chunks for a backfill.

    The last chunk takes in a remainder smaller than a quarter of `size_us` or than `min_us`.
    """
    step = max(size_us, min_us)
    keys = [c for c in ranges.columns if c not in ("lo_us", "hi_us")]
    left = F.col("hi_us") - F.col("chunk_lo_us")
    small = (F.col("chunk_lo_us") > F.col("lo_us")) & (
        (left < size_us // 4) | (left < min_us)
    )
    chunks = (
        ranges.filter(F.col("lo_us") < F.col("hi_us"))
        .withColumn(
            "_lo", F.explode(F.sequence(F.col("lo_us"), F.col("hi_us") - 1, F.lit(step)))
        )
        .withColumnRenamed("_lo", "chunk_lo_us")
        .filter(~small)
    )
    order = Window.partitionBy(*keys).orderBy("chunk_lo_us")
    return chunks.select(
        *keys,
        (F.row_number().over(order) - 1).cast("long").alias("chunk"),
        "chunk_lo_us",
        F.coalesce(F.lead("chunk_lo_us").over(order), F.col("hi_us")).alias("chunk_hi_us"),
    )


def chunk_index(us: Column, lo: Column, hi: Column, size_us: int, min_us: int = 1) -> Column:
    """Number of the chunk of `range_chunks` that holds `us`, by arithmetic, without a join."""
    step = max(size_us, min_us)
    full = F.call_function("div", hi - lo, F.lit(step))
    rest = (hi - lo) % step
    # A remainder is a chunk of its own unless it is small and there is a chunk before it.
    merged = (rest < size_us // 4) | (rest < min_us) | (rest == 0)
    last = F.greatest(F.lit(0).cast("long"), F.when(merged, full - 1).otherwise(full))
    return F.least(F.call_function("div", us - lo, F.lit(step)), last)
