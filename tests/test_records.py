"""Scans, record shaping and text forms on hand-written rows."""

import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import ZERO_US, at, change, change_frame, tuples
from tidemark.functions import times
from tidemark.functions.records import change_key_text, entity_key_text, json_line, to_records
from tidemark.operators.duplicates import ENTITY_KEY, check_key
from tidemark.schema import RECORD_FIELDS
from tidemark.sources import scan


def test_range_is_half_open_and_skips_null(spark):
    rows = [
        change("t1", "lo", at("00:00:10")),
        change("t1", "hi", at("00:00:20")),
        change("t1", "in", at("00:00:19.999999")),
        change("t1", "before", at("00:00:09.999999")),
        change("t1", "null", None),
    ]
    changes = change_frame(spark, rows)
    lo, hi = ZERO_US + 10_000_000, ZERO_US + 20_000_000
    want = [("in",), ("lo",)]
    assert tuples(scan.poll_scan_micros(changes, lo, hi), "event_id") == want
    text = scan.poll_scan(changes, "2024-01-01 00:00:10.000000", "2024-01-01T00:00:20+00:00")
    assert tuples(text, "event_id") == want
    assert text.columns == ["event_id", "change_type", "payload", "change_timestamp"]


def test_lookback_reads_from_the_middle(spark):
    changes = change_frame(spark, [change("t1", str(s), at(f"00:00:{s:02}")) for s in range(60)])
    rows = scan.lookback_scan(
        changes, ZERO_US + 41_000_000, ZERO_US + 20_000_000, ZERO_US + 50_000_000
    )
    late = to_records(rows, "t1", ZERO_US + 41_000_000)
    got = sorted((int(i), x) for i, x in tuples(late, "event_id", "is_late"))
    assert got == [(s, s < 41) for s in range(31, 50)]


def test_time_order(spark):
    rows = [change("t1", str(s), at(f"00:00:{s:02}")) for s in (3, 1, 2, 2, 0)]
    ids = [r.event_id for r in scan.in_time_order(change_frame(spark, rows)).collect()]
    assert ids == ["0", "1", "2", "2", "3"]


def test_null_stays_null_and_missing_gets_a_default(spark):
    rows = change_frame(spark, [change("t1", None, at("00:00:01"), None)])
    first = to_records(rows).first()
    assert first.event_id is None and first.change_type is None
    bare = to_records(rows.select("change_timestamp"), "t2")
    record = json.loads(bare.select(json_line(bare).alias("line")).first().line)
    assert record == {
        "event_id": "NULL",
        "change_type": "UNKNOWN",
        "change_timestamp": "2024-01-01T00:00:01+00:00",
        "table_name": "t2",
        "payload": {},
        "is_late": False,
        "is_duplicate": False,
    }
    assert list(record) == RECORD_FIELDS


def test_feed_packs_other_columns(spark):
    feed = spark.createDataFrame(
        [("INSERT", at("00:00:01"), 7, "x"), ("DELETE", at("00:00:02"), 8, None)],
        "_CHANGE_TYPE string, _CHANGE_TIMESTAMP timestamp, a int, b string",
    )
    rows = scan.change_feed_scan(feed, ZERO_US, ZERO_US + 2_000_000)
    assert rows.columns == ["change_type", "change_timestamp", "payload"]
    records = to_records(rows, "f")
    assert tuples(records, "event_id", "payload.a", "payload.b") == [("NULL", 7, "x")]
    with pytest.raises(ValueError):
        check_key(ENTITY_KEY, feed=True)


def test_fan_in_tags_tables(spark):
    one = change_frame(spark, [change("x", "1", at("00:00:01"))]).drop("table_name")
    two = change_frame(spark, [change("x", "2", at("00:00:01"))]).drop("table_name")
    assert tuples(scan.fan_in({"a": one, "b": two}), "table_name", "event_id") == [
        ("a", "1"),
        ("b", "2"),
    ]


def test_json_keeps_micros_nulls_and_order(spark):
    rows = [
        change("t1", "1", at("00:00:07.179575")),
        change("t1", "é", at("00:00:07")),
        ("t1", None, "INSERT", None, at("00:00:08")),
    ]
    records = to_records(change_frame(spark, rows))
    lines = [r.line for r in records.select(json_line(records).alias("line")).collect()]
    first, second, third = [json.loads(x) for x in lines]
    assert list(first) == RECORD_FIELDS
    assert first["change_timestamp"] == "2024-01-01T00:00:07.179575+00:00"
    assert first["payload"]["created_at"] == "2024-01-01 00:00:07.179575+00:00"
    assert second["change_timestamp"] == "2024-01-01T00:00:07+00:00"
    assert second["payload"]["created_at"] == "2024-01-01 00:00:07+00:00"
    assert second["event_id"] == "é"
    assert third["event_id"] is None and third["payload"] is None


def test_time_functions(spark):
    us = [0, 1, 999_999, 1_000_000, ZERO_US + 179_575, -1]
    df = spark.createDataFrame([(u,) for u in us], "us long")
    ts = F.timestamp_micros("us")
    got = df.select(
        "us",
        times.to_micros(ts),
        times.seconds_to_micros(F.lit(1.9999999)),
        times.micros_text(F.col("us")),
        times.text_to_micros(times.micros_text(F.col("us"))),
        times.midpoint(F.col("us"), F.lit(0)),
        times.window_text(ts),
    ).collect()
    assert [r[1] for r in got] == us and [r[4] for r in got] == us
    assert {r[2] for r in got} == {1_999_999}
    assert [r[5] for r in got] == [u // 2 for u in us]
    assert got[4][3] == "2024-01-01 00:00:00.179575"
    assert got[4][6] == "20240101-000000"


def test_keys(spark):
    rows = [
        change("t1", "1", at("00:00:01")),
        ("t1", "2", "UPDATE", ("", "u", 1.0, None, None), at("00:00:01")),
        ("t1", "3", "UPDATE", None, at("00:00:01")),
    ]
    records = to_records(change_frame(spark, rows))
    stamp = "2024-01-01T00:00:01+00:00"
    assert tuples(records.select(change_key_text().alias("k")), "k") == [
        (f"INSERT-o-1-{stamp}",),
        (f"UPDATE-2-{stamp}",),
        (f"UPDATE-3-{stamp}",),
    ]
    assert tuples(records.select(entity_key_text().alias("k")), "k")[0] == ("t1:1",)
