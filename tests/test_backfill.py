"""A backfill that is stopped and gone on with."""

from collections import Counter

import pytest

from tests.helpers import ZERO_US, at, change, change_frame
from tidemark.plans.backfill import Backfill
from tidemark.sources import tables
from tidemark.streaming.poll_loop import stored_tables

HOUR = 3_600_000_000


def test_chunks_are_read_once_in_the_end(spark, tmp_path, monkeypatch):
    root, path = str(tmp_path / "tables"), str(tmp_path / "out")
    rows = [change(f"t{n % 2}", str(n), at(f"{n // 4:02}:{n % 60:02}:00")) for n in range(90)]
    tables.create_tables(spark, root, ["t0", "t1"])
    tables.append_changes(change_frame(spark, rows), root)
    scanned = []

    def scan(ranges):
        scanned.append(ranges)
        return stored_tables(spark, root)(ranges)

    ranges = [("t0", ZERO_US, ZERO_US + 24 * HOUR), ("t1", ZERO_US + HOUR, ZERO_US + 10 * HOUR)]

    def job(size=2 * HOUR):
        return Backfill(spark, scan, path, ranges, size, chunks_at_once=3)

    first = job()
    assert first.run(most=1) == 3 and first.finished() == {0}
    # The third group's entry is lost after its rows were written.
    with monkeypatch.context() as m:
        m.setattr("tidemark.plans.backfill.mark_done", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            first.run()
    assert first.finished() == {0}
    second = job()
    assert second.run() == 0 and second.finished() == {0, 1, 2, 3}
    # The first group was read once, the one that was lost twice.
    assert [r[0][1] for r in scanned].count(ZERO_US) == 1
    got = second.rows().collect()
    want = {n for n in range(90) if n % 2 == 0 or HOUR <= (n // 4 * 60 + n % 60) * 60_000_000 < 10 * HOUR}
    assert Counter(r.event_id for r in got) == Counter(map(str, want))
    assert {(r.table_name, r.chunk): r.rows for r in second.ledger().collect()} == Counter((r.table_name, r.chunk) for r in got)
    assert all(r.chunk == n // 4 // 2 for r in got if r.table_name == "t0" for n in [int(r.event_id)] if n < 64 and n % 60 < 60 and n // 4 * 60 + n % 60 < (n // 4 + 1) * 60)
    with pytest.raises(ValueError):
        job(size=HOUR)
    with pytest.raises(ValueError):
        Backfill(spark, scan, str(tmp_path / "other"), [("t0", 0, 9), ("t0", 9, 18)], 3)
