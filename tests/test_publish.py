"""Closed windows become files with names."""

import json
from collections import Counter
from pathlib import Path

import pytest

from tests.helpers import at, change, change_frame
from tidemark.functions.records import to_records
from tidemark.sinks import ndjson, publish

ONE, TWO = "20240101-000100", "20240101-000200"


@pytest.fixture
def placed(spark):
    rows = [
        change(f"t{n % 2}", str(n), at(f"00:{n % 3:02}:{n % 60:02}.{n:06}")) for n in range(300)
    ]
    return ndjson.placed_lines(to_records(change_frame(spark, rows)).repartition(6))


def lines(df, until="9"):
    return Counter((r.dest, r.win, r.value) for r in df.collect() if r.win.split("-to-")[1] <= until)


def on_disk(target):
    return {str(p.relative_to(target)) for p in Path(target).glob("t*/output-*.json")}


def names(tables, minutes, shards=1):
    return {
        f"{t}/output-20240101-000{m}00-to-20240101-000{m + 1}00-{s:05}-of-{shards:05}.json"
        for t in tables
        for m in minutes
        for s in range(shards)
    }


def test_raw_files_are_shared_by_input_tasks(spark, tmp_path):
    """Three hours in each of 16 input tasks: two files an hour, opened by several tasks, without checksum files."""
    rows = [change("t0", str(n), at(f"0{n % 3}:{n % 60:02}:00")) for n in range(480)]
    records = to_records(change_frame(spark, rows).repartition(16))
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    publish.write_raw(ndjson.placed_lines(records), str(raw))
    files = [f.name for f in raw.glob("ends=*/part-*")]
    assert len(files) <= 8 and len({n[:10] for n in files}) > 1
    publish.publish_windows(spark, str(raw), out, "20240102-000000")
    assert not [f for k in (raw, Path(out) / "t0") for f in k.rglob(".*.crc")]
    assert publish.read_published(spark, out).count() == 480


@pytest.mark.parametrize("layout", ["raw", "windows"])
def test_closed_windows_have_names(spark, placed, tmp_path, layout):
    source, target = str(tmp_path / "raw"), str(tmp_path / "out")
    if layout == "raw":
        publish.write_raw(placed, source)
        assert len(list(Path(source).glob("ends=*/part-*"))) <= 8
    else:
        placed.write.partitionBy(*ndjson.PLACE).text(source)
    made = publish.publish_windows(spark, source, target, TWO)
    assert {r.path for r in made.collect()} == on_disk(target) == names(["t0", "t1"], [0, 1])
    assert lines(publish.read_published(spark, target)) == lines(placed, TWO)
    assert {(r.shards, r.rows) for r in publish.published_files(spark, target).collect()} == {(1, 50)}
    # Each file holds its own window, one JSON object per line.
    for path in on_disk(target):
        for line in (Path(target) / path).read_text().splitlines():
            record = json.loads(line)
            assert path.startswith(f"{record['table_name']}/output-20240101-00{record['change_timestamp'][14:16]}00")
    # Nothing new: nothing is read or written.
    before = {p: p.stat().st_mtime_ns for p in Path(target).rglob("*")}
    assert publish.publish_windows(spark, source, target, TWO).count() == 0
    assert publish.publish_windows(spark, source, target, ONE).count() == 0
    assert {p: p.stat().st_mtime_ns for p in Path(target).rglob("*")} == before
    # The rest follows when it is closed; what is published stays as it is.
    first = {p: (Path(target) / p).stat().st_mtime_ns for p in on_disk(target)}
    made = publish.publish_windows(spark, source, target, "20240101-000300")
    assert {r.path for r in made.collect()} == names(["t0", "t1"], [2])
    assert lines(publish.read_published(spark, target)) == lines(placed)
    assert all((Path(target) / p).stat().st_mtime_ns == t for p, t in first.items())


def test_only_new_or_open_files_are_opened(spark, placed, tmp_path, monkeypatch):
    source, target = str(tmp_path / "raw"), str(tmp_path / "out")
    opened = []
    rows = publish._Raw.rows
    monkeypatch.setattr(publish._Raw, "rows", lambda self, paths: opened.append(sorted(paths)) or rows(self, paths))
    publish.write_raw(placed, source)
    publish.publish_windows(spark, source, target, "20240101-000300")
    first = opened.pop(0)
    later = [change("t0", str(n), at(f"0{n}:10:00")) for n in range(2, 5)]
    for row in later:
        publish.write_raw(ndjson.placed_lines(to_records(change_frame(spark, [row]))), source)
    opened.clear()
    # Files of the hours between the two times, not those of the first hour, nor of hours to come.
    publish.publish_windows(spark, source, target, "20240101-031100")
    assert [len(paths) for paths in opened] == [2, 6 if len(first) == 6 else len(first)]
    opened.clear()
    publish.publish_windows(spark, source, target, "20240101-041100")
    new, again = opened
    assert new == [] and len(again) == 2 and not set(again) & set(first)
    assert publish.read_published(spark, target).count() == 303


def test_late_rows_join_windows_whose_raw_files_are_gone(spark, placed, tmp_path):
    source, target = str(tmp_path / "raw"), str(tmp_path / "out")
    publish.write_raw(placed, source)
    publish.publish_windows(spark, source, target, TWO)
    late = placed.where("win like '20240101-0000%' and dest = 't0'").limit(3)
    extra = spark.createDataFrame([(f'{{"late":{k}}}', r.dest, r.win) for k, r in enumerate(late.collect())], ndjson.STORED_DDL)
    # Published windows are gone from the raw store, only the open one and the late rows are there.
    emptied = str(tmp_path / "emptied")
    publish.write_raw(placed.where(publish.window_end("win") > TWO), emptied)
    publish.write_raw(extra, emptied)
    made = publish.publish_windows(spark, emptied, target, TWO).collect()
    assert [(r.path, r.rows) for r in made] == [(min(names(["t0"], [0])), 53)]
    assert lines(publish.read_published(spark, target)) == lines(placed, TWO) + lines(extra)
    publish.publish_windows(spark, emptied, target, "20240101-000300")
    assert lines(publish.read_published(spark, target)) == lines(placed) + lines(extra)


def test_files_that_land_during_a_run_are_taken_by_the_next(spark, placed, tmp_path, monkeypatch):
    source, target = str(tmp_path / "raw"), str(tmp_path / "out")
    publish.write_raw(placed, source)
    one = spark.createDataFrame([("{}", "t1", f"20240101-000000-to-{ONE}")], ndjson.STORED_DDL)
    write = publish._write_aside

    def during(*args, **options):
        publish.write_raw(one, source)
        return write(*args, **options)

    monkeypatch.setattr(publish, "_write_aside", during)
    publish.publish_windows(spark, source, target, TWO)
    assert lines(publish.read_published(spark, target)) == lines(placed, TWO)
    monkeypatch.setattr(publish, "_write_aside", write)
    publish.publish_windows(spark, source, target, TWO)
    assert lines(publish.read_published(spark, target)) == lines(placed, TWO) + lines(one)


@pytest.mark.parametrize("moved", [0, 1, 99])
def test_a_run_that_was_cut_off_is_finished(spark, placed, tmp_path, monkeypatch, moved):
    """After any number of files was moved, and also between the moves and the listing."""
    source, target = str(tmp_path / "raw"), str(tmp_path / "out")
    publish.write_raw(placed, source)
    publish.publish_windows(spark, source, target, TWO, max_rows_per_file=20)
    extra = spark.createDataFrame([("{}", f"t{k}", f"20240101-000000-to-{ONE}") for k in range(2)], ndjson.STORED_DDL)
    publish.write_raw(extra, source)
    move = publish.move_files

    def cut_off(spark, moves, threads=16):
        move(spark, moves[:moved], 1)
        raise OSError("lost")

    monkeypatch.setattr(publish, "move_files", cut_off)
    with pytest.raises(OSError):
        publish.publish_windows(spark, source, target, TWO)
    monkeypatch.setattr(publish, "move_files", move)
    publish.publish_windows(spark, source, target, TWO)
    assert lines(publish.read_published(spark, target)) == lines(placed, TWO) + lines(extra)
    # The shards of the windows that were written again are gone.
    assert {p for p in on_disk(target) if "-000000-to-" in p} == names(["t0", "t1"], [0])
    assert all(p in on_disk(target) for p in (r.path for r in publish.published_files(spark, target).collect()))
    assert len(on_disk(target)) == publish.published_files(spark, target).count()


def test_large_windows_have_shards(spark, placed, tmp_path):
    source, target = str(tmp_path / "raw"), str(tmp_path / "out")
    publish.write_raw(placed, source)
    publish.publish_windows(spark, source, target, "20240101-000300", max_rows_per_file=20)
    assert on_disk(target) <= names(["t0", "t1"], [0, 1, 2], 3)
    assert lines(publish.read_published(spark, target)) == lines(placed)


def test_odd_table_names_and_nothing_at_all(spark, tmp_path):
    source, target = str(tmp_path / "raw"), str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        publish.publish_windows(spark, source, target, TWO)
    Path(source).mkdir()
    assert publish.publish_windows(spark, source, target, TWO).count() == 0
    win = f"20240101-000000-to-{ONE}"
    odd = spark.createDataFrame([("{}", d, win) for d in ("a b", "x+y", "50%", "é=ü")], ndjson.STORED_DDL)
    publish.write_raw(odd, source)
    publish.publish_windows(spark, source, target, TWO)
    assert lines(publish.read_published(spark, target)) == lines(odd)
    assert (Path(target) / "x+y" / f"output-{win}-00000-of-00001.json").read_text() == "{}\n"
