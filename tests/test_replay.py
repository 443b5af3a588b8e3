"""Replays against a simulation that takes one poll after the other."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.helpers import position_frame, simulate_contiguous, simulate_lookback, tuples
from tidemark.operators import polls, replay

POLLS = 40


def random_tables(seed: int, start: int, step: int, delay: int) -> list[tuple]:
    """Many small tables of different density, some quiet for a while, some all at one instant."""
    rng = random.Random(seed)
    rows = []
    for t in range(150):
        spots = rng.sample(range(POLLS - 5), rng.choice([1, 2, 5, 20]))
        for i in range(rng.choice([1, 3, 10, 40])):
            us = start + rng.choice(spots) * step + rng.choice([0, step - 1, rng.randrange(step)])
            rows.append((f"t{t}", i, us, us + rng.choice([0, rng.randrange(delay + 1)])))
        rows.append((f"t{t}", -1, start - rng.randrange(1, step), start))
    return rows


def by_table(rows):
    tables = defaultdict(list)
    for table, i, us, arrival in rows:
        tables[table].append((i, us, arrival))
    return tables


@pytest.mark.parametrize("start,step", [(1000, 7), (1_704_067_200_000_000, 900_000_000)])
@pytest.mark.parametrize("attach", [{}, {"broadcast_rows": 0, "hot_groups": 3}])
def test_lookback_replay(spark, start, step, attach):
    rows = random_tables(1, start, step, 0)
    got = replay.lookback_replay(position_frame(spark, rows), start, step, **attach)
    want = sorted(
        (table, *hit)
        for table, own in by_table([(t, i, us, us) for t, i, us, _ in rows]).items()
        for hit in simulate_lookback(own, start, step, POLLS)
    )
    assert tuples(got, "table_name", "id", "poll", "is_late") == want


@pytest.mark.parametrize("start,step,delay", [(1000, 7, 30), (1000, 1000, 4000), (50, 2, 9)])
@pytest.mark.parametrize("attach", [{}, {"broadcast_rows": 0, "hot_groups": 3}])
def test_delayed_replay(spark, start, step, delay, attach):
    rows = random_tables(2, start, step, delay)
    got = replay.delayed_replay(
        position_frame(spark, rows), start, step, "arrival_us", **attach
    )
    want = sorted(
        (table, *hit)
        for table, own in by_table(rows).items()
        for hit in simulate_lookback(own, start, step, POLLS + delay // step + 3)
    )
    assert tuples(got, "table_name", "id", "poll", "is_late") == want


def test_delayed_replay_without_delay_is_lookback_replay(spark):
    rows = [(t, i, us, us) for t, i, us, _ in random_tables(3, 1000, 50, 0)]
    df = position_frame(spark, rows)
    columns = ["table_name", "id", "poll", "is_late"]
    delayed = replay.delayed_replay(df, 1000, 50, "arrival_us")
    assert tuples(delayed, *columns) == tuples(replay.lookback_replay(df, 1000, 50), *columns)


def test_contiguous_replay_loses_what_arrives_late(spark):
    rows = random_tables(4, 1000, 50, 60)
    got = replay.contiguous_replay(position_frame(spark, rows), 1000, 50, "arrival_us")
    want = sorted(
        (table, *hit)
        for table, own in by_table(rows).items()
        for hit in simulate_contiguous(own, 1000, 50, POLLS)
    )
    assert tuples(got, "table_name", "id", "poll") == want


def test_progress_is_the_recurrence(spark):
    rows = random_tables(5, 1000, 50, 0)
    facts = polls.poll_facts(polls.with_poll(position_frame(spark, rows), 1000, 50))
    got = replay.lookback_progress(facts, 1000, 50)
    want = []
    for table, own in by_table(rows).items():
        s = p = 1000
        for k in range(POLLS + 2):
            target = 1000 + (k + 1) * 50
            seen = [us for _, us, _ in own if (s + p) // 2 <= us < target]
            new = [us for us in seen if us >= 1000 + k * 50]
            if not seen:
                continue
            if new:
                want.append((table, k, (s + p) // 2, s, p, target, len(new), max(new) + 1))
            s, p = max([s, *seen]) + 1, s
    columns = "table_name poll scan_lo_us start_us prev_start_us target_us rows next_start_us"
    assert tuples(got, *columns.split()) == sorted(want)
    assert replay.progress_audit(got).filter("not is_valid").count() == 0


def test_audit_finds_a_position_that_fell(spark):
    columns = "table_name string, poll long, scan_lo_us long, start_us long, next_start_us long"
    rows = [("t", 0, 0, 0, 101), ("t", 1, 40, 90, 200), ("t", 2, 201, 201, 150)]
    audit = replay.progress_audit(spark.createDataFrame(rows, columns))
    assert tuples(audit, "poll", "is_valid") == [(0, True), (1, False), (2, False)]


@pytest.mark.parametrize("size,least", [(10, 1), (16, 5), (7, 20), (1000, 1), (4, 1)])
def test_range_chunks(spark, size, least):
    ranges = [(f"r{lo}-{n}", lo, lo + n) for lo in (0, 5) for n in (1, 3, 9, 10, 11, 12, 13, 37, 40)]
    df = spark.createDataFrame(ranges, "name string, lo_us long, hi_us long")

    def cut(lo, hi):
        at = lo
        while at < hi:
            end = min(at + max(size, least), hi)
            if hi - end < size // 4 or hi - end < least:
                end = hi
            yield at, end
            at = end

    want = [
        (name, i, a, b) for name, lo, hi in ranges for i, (a, b) in enumerate(cut(lo, hi))
    ]
    got = polls.range_chunks(df, size, least)
    assert tuples(got, "name", "chunk", "chunk_lo_us", "chunk_hi_us") == sorted(want)
    index = polls.chunk_index(F.col("us"), F.col("lo_us"), F.col("hi_us"), size, least)
    each = df.withColumn("us", F.explode(F.sequence("lo_us", F.col("hi_us") - 1)))
    located = tuples(each.withColumn("chunk", index), "name", "us", "chunk")
    assert located == sorted(
        (name, us, i) for name, i, a, b in want for us in range(a, b)
    )


def test_watermarks_step_by_step(spark):
    rows = random_tables(6, 1000, 50, 120)
    facts = polls.poll_facts(
        polls.with_poll(position_frame(spark, rows), 1000, 50, "arrival_us")
    )
    calendar = polls.poll_calendar(facts)
    second = 1_000_000
    got = {}
    for timeout in (0, None, 100):
        marks = polls.idle_watermarks(calendar, 1000, 50, 0, 0, timeout)
        got[timeout] = {(t, k): w for t, k, w in tuples(marks, "table_name", "poll", "watermark_us")}
    last = max(k for _, k in got[0])
    for table, own in by_table(rows).items():
        arrived = defaultdict(list)
        for _, us, arrival in own:
            if us >= 1000:
                arrived[(max(us, arrival) - 1000) // 50].append(us)
        for timeout, marks in got.items():
            mark, active = 1000, 1000
            for k in range(last + 1):
                end = 1000 + (k + 1) * 50
                if arrived[k]:
                    mark, active = max(mark, *arrived[k]), end
                elif timeout is not None and end - active >= timeout:
                    mark = max(mark, end)
                assert marks[table, k] == mark, (table, k, timeout)
    slow = polls.slowest_watermark(polls.idle_watermarks(calendar, 1000, 50, 0, 0, None))
    assert {k: w for k, w in tuples(slow, "poll", "watermark_us")} == {
        k: min(w for (_, kk), w in got[None].items() if kk == k) for k in range(last + 1)
    }


def test_watermark_lags(spark):
    second = 1_000_000
    facts = spark.createDataFrame(
        [("t", 0, 40 * second), ("t", 2, 35 * second), ("t", 3, 100 * second)],
        "table_name string, poll long, max_us long",
    )
    multi = polls.watermark_multi(facts, 0)
    assert tuples(multi, "poll", "watermark_us") == [
        (0, 10 * second), (2, 10 * second), (3, 70 * second)
    ]
    single = polls.watermark_single(facts, 500 * second)
    assert tuples(single, "poll", "watermark_us") == [
        (0, 200 * second), (2, 200 * second), (3, 200 * second)
    ]


def test_due_tables(spark):
    rows = [("late", 100, 50), ("waits", 100, 201), ("caught_up", 200, 100), ("due", 199, 200)]
    state = spark.createDataFrame(rows, "table_name string, start_us long, next_due_us long")
    assert tuples(polls.due_tables(state, 200), "table_name") == [("due",), ("late",)]


def test_audit_of_commits(spark):
    """Each kind of false commit is found, and only there."""
    from tidemark.streaming.poll_loop import PROGRESS_DDL

    names = [c.split()[0] for c in PROGRESS_DDL.split(", ")]
    # Rows at 100 and 150, then none, then at 300.
    states = [(0, 0, 0, 200, 2, 151, 0, 70), (75, 151, 0, 400, 1, 301, 151, 270), (226, 301, 151, 500, 0, 301, 151, 270)]
    good = [
        dict(zip(names, (k, "t", lo, start, prev, target, True, rows, nxt, nxt_prev, mark, 0, 0, "committed")))
        for k, (lo, start, prev, target, rows, nxt, nxt_prev, mark) in enumerate(states)
    ]
    records = spark.createDataFrame([("t", 0, 100), ("t", 0, 150), ("t", 1, 300)], "table_name string, batch_id int, us long")

    def checks(commits):
        got = replay.commit_audit(spark.createDataFrame(commits, PROGRESS_DDL), records)
        return [tuple(r)[2:] for r in got.orderBy("poll").collect()]

    fine = (True, True, True, True)
    assert checks(good) == [fine] * 3
    for place, change, bad in [
        (1, {"start": 150, "scan_lo": 75}, [fine, (False, True, True, True), fine]),
        (1, {"scan_lo": 80}, [fine, (False, True, True, True), fine]),
        (2, {"next_start": 302}, [fine, fine, (True, False, True, True)]),
        (1, {"rows": 2}, [fine, (True, True, False, True), fine]),
        (2, {"watermark": 269}, [fine, fine, (True, True, True, False)]),
    ]:
        commits = [{**row, **(change if k == place else {})} for k, row in enumerate(good)]
        if place == 1 and "start" in change:
            commits[1]["next_prev"] = 150
            commits[2]["prev_start"] = commits[2]["next_prev"] = 150
            commits[2]["scan_lo"] = (301 + 150) // 2
        assert checks(commits) == bad, change
