"""Polls stepped in segments are the polls stepped one by one."""

import random

import pytest

from tests.helpers import tuples
from tidemark.operators import segments

START = 1000


def stepped(facts):
    """Positions of the polls of one table, from the first to the last; facts are (poll, max, rows)."""
    start = prev = START
    out, before = [], None

    def advance(poll, rows, own):
        nonlocal start, prev
        floor = (start + prev) // 2
        reach = [m for m in (own, before[1] if before else None) if m is not None and m >= floor]
        reached = max([start, *reach]) if reach else None
        if reach:
            new = (reached + 1, start)
        else:
            new = (start, prev)
        out.append((poll, floor, start, prev, rows, reached, (new[0] + new[1]) // 2))
        start, prev = new

    for poll, most, rows in facts:
        if before and poll > before[0] + 1:
            advance(before[0] + 1, 0, None)
            before = None
        advance(poll, rows, most)
        before = (poll, most)
    if before:
        advance(before[0] + 1, 0, None)
    return out


def random_facts(rnd, n):
    """Rows that are on time, late, or so late that they are lost, with quiet polls between."""
    poll, out = rnd.randint(0, 5), []
    lateness = rnd.choice([0, 60, 400, 2000])
    for _ in range(n):
        most = START + poll * 50 + rnd.randint(0, 49) - (rnd.randint(0, lateness) if rnd.random() < 0.6 else 0)
        out.append((poll, max(START, most), rnd.randint(1, 9)))
        poll += rnd.choice([1, 1, 1, 2, 3, 40])
    return out


@pytest.mark.parametrize("segment,warm_up", [(1, 1), (3, 1), (7, 2), (16, 64), (1000, 5)])
def test_three_thousand_random_tables(spark, segment, warm_up):
    rnd = random.Random(segment)
    cases = {f"t{k}": random_facts(rnd, rnd.randint(1, 30)) for k in range(600)}
    rows = [(t, *f) for t, facts in cases.items() for f in facts]
    facts = spark.createDataFrame(rows, "table_name string, poll long, max_us long, rows long")
    got = segments.progress(facts, START, segment, warm_up)
    columns = "table_name poll scan_lo_us start_us prev_start_us rows reached_us again_us"
    assert got.columns == columns.split()
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(
        ((t, *r) for t, own in cases.items() for r in stepped(own)), key=lambda r: r[:2]
    )


def test_one_long_table_is_stepped_in_many_tasks(spark):
    rnd = random.Random(9)
    own = random_facts(rnd, 20_000)
    facts = spark.createDataFrame([("t", *f) for f in own], "table_name string, poll long, max_us long, rows long")
    cut = segments.cut(facts, 500, 16)
    assert cut.count() > 50
    ends, rounds = segments.settled(cut, START)
    assert rounds <= 4
    got = segments.progress(facts, START, 500, 16).orderBy("poll")
    assert [tuple(r)[1:] for r in got.collect()] == stepped(own)


def test_a_wrong_guess_is_repaired_to_the_end(spark):
    """Rows so late that nothing is found for many segments: the state passes through all of them."""
    own = [(0, 1040, 1), (1, 1090, 1), *[(k, 1005, 1) for k in range(2, 60)], (60, 4010, 1), (61, 4020, 1)]
    facts = spark.createDataFrame([("t", *f) for f in own], "table_name string, poll long, max_us long, rows long")
    got = segments.progress(facts, START, 4, 2).orderBy("poll")
    assert [tuple(r)[1:] for r in got.collect()] == stepped(own)


def test_no_facts(spark):
    none = spark.createDataFrame([], "table_name string, poll long, max_us long, rows long")
    assert tuples(segments.progress(none, START), "table_name") == []
