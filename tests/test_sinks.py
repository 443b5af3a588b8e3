"""Files by table and window."""

import json
from collections import Counter

import pytest

from tests.helpers import at, change, change_frame, tuples
from tidemark.functions.records import to_records
from tidemark.operators.windows import with_destination
from tidemark.sinks import ndjson
from tidemark.sources import tables


@pytest.fixture
def records(spark):
    rows = [
        change(f"t{n % 2}", str(n), at(f"00:{n % 3:02}:{n % 60:02}.{n:06}")) for n in range(300)
    ]
    return to_records(change_frame(spark, rows))


def stored(spark, path):
    lines = ndjson.read_windows(spark, path).select("*", "_metadata.file_path").collect()
    files = {}
    for r in lines:
        files.setdefault((r.dest, r.win), set()).add(r.file_path)
    return lines, files


def test_one_file_per_table_and_window(spark, records, tmp_path):
    path = str(tmp_path / "out")
    ndjson.write_windows(with_destination(records.repartition(6)), path)
    lines, files = stored(spark, path)
    assert len(lines) == 300
    assert len(files) == 6 and all(len(f) == 1 for f in files.values())
    for r in lines:
        record = json.loads(r.value)
        assert record["table_name"] == r.dest
        minute = record["change_timestamp"][14:16]
        assert r.win == f"20240101-00{minute}00-to-20240101-00{int(minute) + 1:02}00"
    assert ndjson.written_files(spark, path).count() == 6
    order = {}
    for r in lines:
        order.setdefault(r.file_path, []).append(json.loads(r.value)["change_timestamp"])
    assert all(stamps == sorted(stamps) for stamps in order.values())


def test_windows_are_plain_files_written_by_all_cores(spark, records, tmp_path):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        ndjson.write_windows(with_destination(records.coalesce(1)), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    names = [f.name for f in (tmp_path / "out").glob("dest=*/win=*/part-*")]
    assert len(names) == 6 and len({n[:10] for n in names}) > 1
    assert not list((tmp_path / "out").glob("dest=*/win=*/.*.crc"))
    assert ndjson.read_windows(spark, str(tmp_path / "out")).count() == 300


def test_large_windows_are_written_in_shards(spark, records, tmp_path):
    path = str(tmp_path / "out")
    ndjson.write_windows(with_destination(records.repartition(6)), path, max_rows_per_file=10)
    lines, files = stored(spark, path)
    assert len(lines) == 300
    assert all(2 <= len(f) <= 5 for f in files.values())


def test_copies_of_one_line_are_spread(spark, tmp_path):
    rows = change_frame(spark, [change("t", "1", at("00:00:01"))] * 200).repartition(20)
    path = str(tmp_path / "out")
    ndjson.write_windows(with_destination(to_records(rows)), path, max_rows_per_file=50)
    lines, files = stored(spark, path)
    assert len(lines) == 200
    (only,) = files.values()
    assert 2 <= len(only) <= 4


def test_lines_of_one_table(spark, tmp_path):
    rows = change_frame(spark, [change("t", "1", at("00:00:07.179575"))]).drop("table_name")
    ndjson.write_lines(rows, str(tmp_path / "out"), rows.columns)
    line = spark.read.text(str(tmp_path / "out")).first().value
    record = json.loads(line)
    assert list(record) == ["event_id", "change_type", "payload", "change_timestamp"]
    assert record["change_timestamp"] == "2024-01-01T00:00:07.179575+00:00"


def test_change_tables(spark, tmp_path):
    root = str(tmp_path)
    tables.create_tables(spark, root, ["t0", "t1"])
    assert tables.read_table(spark, root, "t0").count() == 0
    first = [change("t0", "1", at("23:59:59.999999")), change("t1", "2", at("00:00:00"))]
    tables.append_changes(change_frame(spark, first), root)
    tables.create_tables(spark, root, ["t0", "t1", "t2"])
    tables.append_changes(change_frame(spark, [change("t0", "3", at("24:00:00"))]), root)
    t0 = tables.read_table(spark, root, "t0")
    assert [(i, str(d)) for i, d in tuples(t0, "event_id", "change_date")] == [
        ("1", "2024-01-01"),
        ("3", "2024-01-02"),
    ]
    day = 86_400_000_000
    lo = 1_704_067_200_000_000
    assert tuples(tables.read_table(spark, root, "t0", lo, lo + 1), "event_id") == [("1",)]
    assert tables.read_table(spark, root, "t0", lo - 9 * day, lo - day).count() == 0
    assert tables.read_table(spark, root, "t2").count() == 0
    ranges = [("t0", lo, lo + day + 1), ("t1", lo + 1, lo + day), ("t2", lo, lo + day)]
    assert tuples(tables.scan_tables(spark, root, ranges), "table_name", "event_id") == [
        ("t0", "1"),
        ("t0", "3"),
    ]
    ranges[1] = ("t1", lo - 400 * day, lo + 1)
    found = tables.scan_tables(spark, root, ranges)
    assert tuples(found, "table_name", "event_id") == [("t0", "1"), ("t0", "3"), ("t1", "2")]
    assert tables.scan_tables(spark, root, [("t0", lo - day, lo - 1)]).count() == 0


def test_bad_lines_are_reported_and_the_rest_goes_on(spark):
    good = '{"event_id":"1","change_type":"INSERT","payload":{"order_id":"o-1","price":2.5},' \
        '"change_timestamp":"2024-01-01T00:00:07.179575+00:00"}'
    lines = spark.createDataFrame(
        [(good, "t"), ("{not json", "t"), ('{"event_id":"2","change_timestamp":"noon"}', "t")],
        "value string, table_name string",
    )
    changes, rejected = tables.parse_change_lines(lines)
    row = changes.first()
    assert (row.event_id, row.payload.order_id, row.payload.price) == ("1", "o-1", 2.5)
    assert changes.count() == 1 and rejected.count() == 2
