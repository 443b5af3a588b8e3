"""Lookback polls stepped through in segments, many at a time.

Where rows arrive late, what a poll finds depends on the polls before it: a state of two positions, the start S and
the previous start P, is handed from poll to poll. But a poll that finds rows up to m >= S leaves S = m + 1, and
two of them leave nothing of the state they began with. So the polls of a table are cut into segments of `SEGMENT`
poll facts, each segment is stepped from a guess, and wherever the state at the end of a segment
is not the one its successor began with, the successor is stepped again, until all agree. A segment's first
guess is the largest position of all segments before, and is carried through the last `WARM_UP` facts of the one before.

Each round makes at least the first wrong segment right for good, so the result is that of stepping a table from its
first poll to its last. Rounds look at one row per segment; no task holds more than a segment's facts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

SEGMENT = 4096
WARM_UP = 64

_ENDS = "table_name string, segment long, start_us long, prev_us long, end_start_us long, end_prev_us long"
_STEPS = (
    "table_name string, poll long, scan_lo_us long, start_us long, prev_start_us long, rows long, "
    "reached_us long, again_us long"
)


def _walk(
    polls: list[int], maxes: list[int], before: tuple[int, int] | None, last: bool
) -> Iterator[tuple[int, int, int]]:
    """(poll, number of the fact or -1, largest position in reach) of each poll that can find rows.

    The poll after one with new rows can find these again, even if it has none of its own. `before` is the last
    fact ahead of the segment.
    """
    poll_before, max_before = before or (None, None)
    for k, (poll, most) in enumerate(zip(polls, maxes)):
        if poll_before is not None:
            if poll > poll_before + 1:
                yield poll_before + 1, -1, max_before
            elif max_before > most:
                most = max_before
        yield poll, k, most
        poll_before, max_before = poll, maxes[k]
    if last and poll_before is not None:
        yield poll_before + 1, -1, max_before


def _after(start: int, prev: int, most: int) -> tuple[int, int]:
    """The state after a poll that can reach `most`."""
    return (max(start, most) + 1, start) if most >= (start + prev) >> 1 else (start, prev)


def cut(facts: DataFrame, segment: int = SEGMENT, warm_up: int = WARM_UP) -> DataFrame:
    """One row per table and segment with its facts in order, and what it must know of the ones before.

    `facts` has table_name, poll, max_us and rows.
    """
    numbered = facts.select("table_name", F.call_function("div", "poll", F.lit(segment)).alias("segment"), "poll", "max_us", "rows")
    each = F.sort_array(F.collect_list(F.struct("poll", "max_us", "rows")))
    rows = numbered.groupBy("table_name", "segment").agg(each.alias("facts"))
    rows = rows.select(
        "table_name",
        "segment",
        *[F.col(f"facts.{c}").alias(a) for c, a in (("poll", "polls"), ("max_us", "maxes"), ("rows", "counts"))],
    )
    # One row per segment of a table from here on.
    order = Window.partitionBy("table_name").orderBy("segment")
    tail = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - warm_up), warm_up + 1)
    return rows.select(
        "*",
        F.lag(tail("polls")).over(order).alias("polls_before"),
        F.lag(tail("maxes")).over(order).alias("maxes_before"),
        F.max(F.array_max("maxes")).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("most_before"),
        F.lead("segment").over(order).isNull().alias("is_last"),
    )


def _guessed(cut_rows: DataFrame, start_us: int) -> DataFrame:
    """Each segment stepped from a guess: _ENDS."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                start = prev = start_us
                if r["most_before"] is not None:
                    start = prev = max(start_us, r["most_before"] + 1)
                    polls, maxes = r["polls_before"], r["maxes_before"]
                    for _, _, most in _walk(polls[1:], maxes[1:], (polls[0], maxes[0]), False):
                        start, prev = _after(start, prev, most)
                out.append((r["table_name"], r["segment"], start, prev, *_end(r, start, prev)))
            yield _batch(pa, out, _ENDS)

    return cut_rows.mapInArrow(run, _ENDS)


def _before(r: dict) -> tuple[int, int] | None:
    return (r["polls_before"][-1], r["maxes_before"][-1]) if r["polls_before"] else None


def _end(r: dict, start: int, prev: int) -> tuple[int, int]:
    for _, _, most in _walk(r["polls"], r["maxes"], _before(r), r["is_last"]):
        start, prev = _after(start, prev, most)
    return start, prev


def _batch(pa, rows: list[tuple], ddl: str):
    fields = [c.split() for c in ddl.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)],
        names=[name for name, _ in fields],
    )


def _stepped(rows: DataFrame) -> DataFrame:
    """Segments with a start (`start_us`, `prev_us`) stepped to their end."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                start, prev = r["start_us"], r["prev_us"]
                out.append((r["table_name"], r["segment"], start, prev, *_end(r, start, prev)))
            yield _batch(pa, out, _ENDS)

    return rows.mapInArrow(run, _ENDS)


def settled(cut_rows: DataFrame, start_us: int) -> tuple[DataFrame, int]:
    """The state at which every segment begins (_ENDS), and how many rounds that took."""
    ends = stage(_guessed(cut_rows, start_us), "segment-ends")
    order = Window.partitionBy("table_name").orderBy("segment")
    rounds = 1
    while True:
        # What the segment before ended with; the first one began with the table's start.
        handed = ends.select(
            "*", F.lag("end_start_us").over(order).alias("s"), F.lag("end_prev_us").over(order).alias("p")
        )
        agrees = F.col("s").isNull() | ((F.col("s") == F.col("start_us")) & (F.col("p") == F.col("prev_us")))
        wrong = handed.where(~agrees).select("table_name", "segment", F.col("s").alias("start_us"), F.col("p").alias("prev_us"))
        wrong = stage(wrong, "segments-again")
        if wrong.isEmpty():
            return ends, rounds
        again = _stepped(cut_rows.join(wrong, ["table_name", "segment"]))
        kept = ends.join(wrong.select("table_name", "segment"), ["table_name", "segment"], "left_anti")
        ends = stage(kept.unionByName(again), "segment-ends")
        rounds += 1


def progress(facts: DataFrame, start_us: int, segment: int = SEGMENT, warm_up: int = WARM_UP) -> DataFrame:
    """Every poll that can find rows: its positions, its new rows, the position it reached, and the next one's floor.

    Columns are table_name, poll, scan_lo_us, start_us, prev_start_us, rows, reached_us (NULL if nothing was found)
    and again_us, from which on the next poll finds rows.
    """
    segments = stage(cut(facts, segment, warm_up), "segments")
    ends, _ = settled(segments, start_us)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                start, prev = r["start_us"], r["prev_us"]
                for poll, k, most in _walk(r["polls"], r["maxes"], _before(r), r["is_last"]):
                    floor = (start + prev) >> 1
                    reached = max(start, most) if most >= floor else None
                    after = _after(start, prev, most)
                    rows = r["counts"][k] if k >= 0 else 0
                    out.append((r["table_name"], poll, floor, start, prev, rows, reached, sum(after) >> 1))
                    start, prev = after
            yield _batch(pa, out, _STEPS)

    starts = ends.select("table_name", "segment", "start_us", "prev_us")
    return segments.join(starts, ["table_name", "segment"]).mapInArrow(run, _STEPS)
