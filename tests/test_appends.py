"""Lines appended batch by batch, and what is rejected."""

import json
from collections import Counter

import pytest

from tidemark.sources import appends, tables


def line(n, stamp="2024-01-0{}T00:00:07.179575+00:00"):
    return json.dumps({"event_id": str(n), "change_type": "INSERT", "payload": {"order_id": f"o-{n}"}, "change_timestamp": stamp.format(1 + n % 3)})


LINES = [
    *[(line(n), "t1" if n % 2 else "t2") for n in range(6)],
    ("{broken", "t1"),
    ('{"event_id":"7"}', "t1"),
    (line(8, "noon"), "t2"),
    (line(9), "unknown"),
    (None, "t2"),
    (line(10), None),
]
REASONS = Counter({appends.NO_JSON: 3, appends.NO_TIME: 1, appends.NO_TABLE: 2})


@pytest.fixture
def root(spark, tmp_path):
    tables.create_tables(spark, str(tmp_path / "root"), ["t1", "t2"])
    return str(tmp_path / "root")


def stored(spark, root):
    return Counter(r.event_id for t in ("t1", "t2") for r in tables.read_table(spark, root, t).collect())


def frame(spark, rows=LINES):
    return spark.createDataFrame(rows, "value string, table_name string")


def test_good_lines_are_stored_and_others_reported(spark, root):
    appends.append_lines(frame(spark), root, 0)
    appends.append_lines(frame(spark), root, 0)
    assert stored(spark, root) == Counter(map(str, range(6)))
    bad = appends.rejected_lines(spark, root).collect()
    assert Counter(r.reason for r in bad) == REASONS and {r.batch for r in bad} == {0}
    assert {r.value for r in bad if r.reason == appends.NO_TABLE} == {line(9), line(10)}
    appends.append_lines(frame(spark), root, 1)
    assert stored(spark, root) == Counter({str(n): 2 for n in range(6)})
    assert appends.rejected_lines(spark, root).count() == 12


@pytest.mark.parametrize("moved", [0, 1, 3])
def test_a_batch_that_was_cut_off_is_appended_once(spark, root, monkeypatch, moved):
    move = appends.move_files

    def cut_off(spark, moves, threads=16):
        move(spark, moves[:moved], 1)
        raise OSError("lost")

    monkeypatch.setattr(appends, "move_files", cut_off)
    with pytest.raises(OSError):
        appends.append_lines(frame(spark), root, 0)
    monkeypatch.setattr(appends, "move_files", move)
    # Other lines under the same number: the plan of the first attempt holds.
    appends.append_lines(frame(spark, LINES[:1]), root, 0)
    assert stored(spark, root) == Counter(map(str, range(6)))
    assert Counter(r.reason for r in appends.rejected_lines(spark, root).collect()) == REASONS


def test_stream_of_lines(spark, root, tmp_path):
    path = str(tmp_path / "lines")
    for part in (LINES[:4], [r for r in LINES[4:] if r[0] is not None and r[1] is not None]):
        frame(spark, part).coalesce(1).write.mode("append").partitionBy("table_name").text(path)
        stream = appends.stream_lines(spark, path, files_per_batch=1)
        appends.append_stream(stream, root, str(tmp_path / "checkpoint")).awaitTermination()
    assert stored(spark, root) == Counter(map(str, range(6)))
    assert appends.rejected_lines(spark, root).count() == 4


def test_no_tables_and_no_lines(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    appends.append_lines(frame(spark, []), str(tmp_path / "empty"), 0)
    assert appends.rejected_lines(spark, str(tmp_path / "empty")).count() == 0
    appends.append_lines(frame(spark, LINES[:2]), str(tmp_path / "empty"), 1)
    assert {r.reason for r in appends.rejected_lines(spark, str(tmp_path / "empty")).collect()} == {appends.NO_TABLE}
