"""What a poller would have emitted over history, poll by poll.

Two ways to advance exist. *Contiguous* polls read `[S, T)` and go on from `T`. *Lookback* polls
read from the middle between the start `S` and the previous start `P`, up to `T`; if there are
rows, the largest position `m` (at least `S`) is claimed and `S, P` become `m + 1, S`; if there
are none, `S` and `P` stay.

A lookback poll seems to need a range join of rows with polls. It does not. Claiming `m`
puts the next start above every row emitted so far, and the poll after that has a floor of at
least that start. So a row can come out of the first poll that sees it and of the next one,
and of no other, and both are found by equality on the poll number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import midpoint, poll_index
from tidemark.operators import segments
from tidemark.operators.groups import attach_facts
from tidemark.operators.polls import by_table, poll_facts, with_poll


def contiguous_replay(
    changes: DataFrame, start_us: int, step_us: int, arrival: str | None = None
) -> DataFrame:
    """Rows with the poll that reads them, `[poll_lo_us, poll_hi_us)`.

    Rows that arrive after the poll over their own time are lost, as in a live run.
    """
    read = with_poll(changes, start_us, step_us)
    if arrival:
        read = read.filter(poll_index(F.col(arrival), start_us, step_us) <= F.col("poll"))
    lo = F.lit(start_us) + F.col("poll") * step_us
    return read.withColumn("poll_lo_us", lo).withColumn("poll_hi_us", lo + step_us)


def lookback_progress(facts: DataFrame, start_us: int, step_us: int) -> DataFrame:
    """Positions of every poll with new rows, where rows are seen at their own time.

    Closed form of the recurrence: the start follows from the last claim, and is one higher if a
    quiet poll in between has claimed its own start.
    """
    first = F.lit(start_us).cast("long")
    quiet = F.col("poll") > F.col("_poll_1") + 1
    quiet_before = F.col("_poll_1") > F.col("_poll_2") + 1
    after_quiet = F.when(quiet, 2).otherwise(1)
    start_before = F.coalesce(F.col("_max_2") + F.when(quiet_before, 2).otherwise(1), first)
    return (
        facts.select(
            "*",
            F.lag("poll", 1).over(by_table()).alias("_poll_1"),
            F.lag("poll", 2).over(by_table()).alias("_poll_2"),
            F.lag("max_us", 1).over(by_table()).alias("_max_1"),
            F.lag("max_us", 2).over(by_table()).alias("_max_2"),
        )
        .withColumn("start_us", F.coalesce(F.col("_max_1") + after_quiet, first))
        .withColumn(
            "prev_start_us",
            F.when(F.col("_max_1").isNull(), first)
            .when(quiet, F.col("_max_1") + 1)
            .otherwise(start_before),
        )
        .select(
            "table_name",
            "poll",
            midpoint(F.col("start_us"), F.col("prev_start_us")).alias("scan_lo_us"),
            "start_us",
            "prev_start_us",
            (F.lit(start_us) + (F.col("poll") + 1) * step_us).alias("target_us"),
            "rows",
            "max_us",
            (F.col("max_us") + 1).alias("next_start_us"),
        )
    )


def _emissions(seen: Column, late: Column, again: Column) -> Column:
    """One row per poll that emits: the poll itself if `seen`, the next one if `again`."""
    once = F.struct(F.col("poll"), late.alias("is_late"))
    twice = F.struct((F.col("poll") + 1).alias("poll"), F.lit(True).alias("is_late"))
    return F.explode(
        F.when(seen & again, F.array(once, twice))
        .when(seen, F.array(once))
        .when(again, F.array(twice))
    )


def _emit(known: DataFrame, columns: list[str], emissions: Column) -> DataFrame:
    keep = [c for c in columns if c not in ("poll", "is_late")]
    return known.select(*keep, emissions.alias("_e")).select(
        *keep, F.col("_e.poll").alias("poll"), F.col("_e.is_late").alias("is_late")
    )


def lookback_replay(
    changes: DataFrame, start_us: int, step_us: int, **attach: int
) -> DataFrame:
    """Everything lookback polls emit when rows are seen at their own time.

    Each row comes once on time, and once more, late, if it lies in the upper half of the range
    its poll claimed.
    """
    polled = with_poll(changes, start_us, step_us)
    plan = lookback_progress(poll_facts(polled), start_us, step_us).select(
        "table_name",
        "poll",
        "rows",
        midpoint(F.col("next_start_us"), F.col("start_us")).alias("_again_us"),
    )
    known = attach_facts(polled, plan, ["table_name", "poll"], "rows", **attach)
    emissions = _emissions(F.lit(True), F.lit(False), F.col("us") >= F.col("_again_us"))
    return _emit(known, polled.columns, emissions)


def delayed_progress(facts: DataFrame, start_us: int, step_us: int, **cut: int) -> DataFrame:
    """Positions of every poll that can emit, where rows arrive late.

    Whether a poll finds rows depends on the polls before it, so the recurrence is stepped through, in segments that
    are repaired until they agree. It steps over poll facts, never over rows, and skips quiet stretches:
    polls without new rows emit nothing from the second one on and change nothing.
    """
    return segments.progress(facts, start_us, **cut)


def delayed_replay(
    changes: DataFrame, start_us: int, step_us: int, arrival: str, **attach: int
) -> DataFrame:
    """Everything lookback polls emit when rows are seen at `arrival`.

    Rows below the floor of the first poll that could see them are lost, as in a live run.
    """
    polled = with_poll(changes, start_us, step_us, arrival)
    progress = delayed_progress(poll_facts(polled), start_us, step_us)
    plan = progress.filter("rows > 0").select(
        "table_name",
        "poll",
        "rows",
        F.col("scan_lo_us").alias("_lo_us"),
        F.col("start_us").alias("_start_us"),
        F.col("again_us").alias("_again_us"),
    )
    known = attach_facts(polled, plan, ["table_name", "poll"], "rows", **attach)
    us = F.col("us")
    emissions = _emissions(
        us >= F.col("_lo_us"), us < F.col("_start_us"), us >= F.col("_again_us")
    )
    return _emit(known, polled.columns, emissions)


def progress_audit(progress: DataFrame) -> DataFrame:
    """Positions must not fall, and a claim must not lie before its start."""
    reached = F.col("next_start_us") - 1
    rising = F.coalesce(F.lag("next_start_us").over(by_table()) <= F.col("start_us"), F.lit(True))
    return progress.withColumn(
        "is_valid",
        rising & (reached >= F.col("start_us")) & (F.col("scan_lo_us") <= F.col("start_us")),
    )


def commit_audit(commits: DataFrame, records: DataFrame) -> DataFrame:
    """Check the commits of live lookback polls against each other and against the records they wrote.

    `commits` is `PollLoop.progress()`, `records` `PollLoop.records()`. Returns table_name, poll and

    * `is_chained`: the poll began where the commit before it ended, and kept the start before that;
    * `is_claim_valid`: it claimed the largest position it wrote, not below its start, or kept its place if it
      wrote nothing;
    * `is_count_valid`: it wrote as many rows as it committed;
    * `is_mark_valid`: the watermark did not fall.

    Rows are counted once per poll and table; nothing else is moved.
    """
    wrote = records.groupBy("table_name", "batch_id").agg(
        F.count(F.lit(1)).alias("_wrote"), F.max("us").alias("_max_us")
    )
    order = Window.partitionBy("table_name").orderBy("batch_id")
    last = lambda c: F.lag(c).over(order)
    known = commits.join(wrote.withColumn("batch_id", F.col("batch_id").cast("long")), ["table_name", "batch_id"], "left")
    chained = (last("next_start") == F.col("start")) & (last("next_prev") == F.col("prev_start"))
    wrote_rows = F.coalesce("_wrote", F.lit(0).cast("long"))
    moved = (F.col("next_start") == F.greatest("start", "_max_us") + 1) & (F.col("next_prev") == F.col("start"))
    stayed = (F.col("next_start") == F.col("start")) & (F.col("next_prev") == F.col("prev_start"))
    floor = F.col("scan_lo") == midpoint(F.col("start"), F.col("prev_start"))
    return known.select(
        "table_name",
        F.col("batch_id").alias("poll"),
        F.coalesce(chained & floor, floor).alias("is_chained"),
        F.when(wrote_rows > 0, moved & (F.col("next_start") <= F.col("target"))).otherwise(stayed).alias("is_claim_valid"),
        (wrote_rows == F.col("rows")).alias("is_count_valid"),
        F.coalesce(last("watermark") <= F.col("watermark"), F.lit(True)).alias("is_mark_valid"),
    )


def backlog(progress: DataFrame, stop_us: int | Column) -> DataFrame:
    """How much of the range up to `stop_us` is left after each poll, and the fraction done."""
    stop = stop_us if isinstance(stop_us, Column) else F.lit(stop_us)
    left = F.greatest(stop - F.col("next_start_us"), F.lit(0).cast("long"))
    size = stop - F.col("start_us")
    done = F.when(size <= 0, 1.0).otherwise(
        (F.col("next_start_us") - 1 - F.col("start_us")) / size
    )
    return progress.withColumn("backlog_us", left).withColumn("fraction_done", done)
