"""The live loop: positions, retries, due tables, watermarks, the tick stream."""

import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import ZERO, ZERO_US, at, change, change_frame, simulate_lookback, tuples
from tidemark.plans import jobs
from tidemark.schema import TableConfig
from tidemark.sinks import publish
from tidemark.sources import tables
from tidemark.streaming import poll_loop
from tidemark.streaming.poll_loop import PollLoop, each_table
from tidemark.streaming.windows import stop_idle

SECOND = 1_000_000


def micros(spark, positions, name="t1"):
    """A change table with rows at the given microseconds."""
    df = spark.createDataFrame([(u,) for u in positions], "us long")
    ts = F.timestamp_micros("us")
    return df.select(
        F.col("us").cast("string").alias("event_id"),
        F.lit("INSERT").alias("change_type"),
        F.struct(
            F.lit("o").alias("order_id"),
            F.lit("u").alias("user_id"),
            F.lit(1.0).alias("price"),
            ts.alias("created_at"),
            ts.alias("updated_at"),
        ).alias("payload"),
        ts.alias("change_timestamp"),
    )


def loop_on(spark, tmp_path, frames, mode="polling", **options):
    configs = [TableConfig(name) for name in frames]
    scan = each_table(lambda name, lo, hi: frames[name], mode)
    return PollLoop(spark, configs, scan, str(tmp_path), **options)


def emitted(loop):
    return tuples(loop.records(), "batch_id", "us", "is_late")


def test_quiet_polls_collapse_the_lookback(spark, tmp_path):
    loop = loop_on(spark, tmp_path, {"t1": micros(spark, [1000, 1500, 5200])}, start_us=100)
    loop.tables = [TableConfig("t1", 0)]
    for batch_id, now in enumerate([2000, 3000, 4000, 6000, 7000]):
        loop.poll(batch_id, now)
    assert emitted(loop) == [
        (0, 1000, False),
        (0, 1500, False),
        (1, 1000, True),
        (1, 1500, True),
        (3, 5200, False),
        (4, 5200, True),
    ]
    positions = tuples(loop.progress(), "batch_id", "start", "prev_start", "rows", "next_start")
    assert positions == [
        (0, 100, 100, 2, 1501),
        (1, 1501, 100, 2, 1502),
        (2, 1502, 1501, 0, 1502),
        (3, 1502, 1501, 1, 5201),
        (4, 5201, 1502, 1, 5202),
    ]


def test_empty_first_poll_keeps_the_position(spark, tmp_path):
    loop = loop_on(spark, tmp_path, {"t1": micros(spark, [])}, start_us=100)
    loop.poll(0, 2000)
    assert tuples(loop.progress(), "next_start", "next_prev", "rows", "watermark") == [
        (100, 100, 0, 100)
    ]


def test_contiguous_polls_and_their_watermark(spark, tmp_path):
    minute = 60 * SECOND
    frames = {"t1": micros(spark, [ZERO_US + s * SECOND for s in (10, 70, 80, 200)])}
    loop = loop_on(
        spark, tmp_path, frames, start_us=ZERO_US, lookback=False, idle_timeout=0
    )
    for batch_id in range(4):
        loop.poll(batch_id, ZERO_US + (batch_id + 1) * minute)
    assert [(b, (us - ZERO_US) // SECOND, late) for b, us, late in emitted(loop)] == [
        (0, 10, False),
        (1, 70, False),
        (1, 80, False),
        (3, 200, False),
    ]
    marks = [(w - ZERO_US) // SECOND for (_, w) in tuples(loop.progress(), "batch_id", "watermark")]
    assert marks == [10, 80, 180, 200]


def test_only_due_tables_are_polled(spark, tmp_path):
    reads = []
    frames = {n: micros(spark, [ZERO_US + 5 * SECOND]) for n in ("fast", "slow")}

    def read(name, lo, hi):
        reads.append(name)
        return frames[name]

    configs = [TableConfig("fast", 30), TableConfig("slow", 60)]
    loop = PollLoop(spark, configs, each_table(read), str(tmp_path), start_us=ZERO_US)
    for batch_id in range(4):
        loop.poll(batch_id, ZERO_US + (batch_id + 1) * 30 * SECOND)
    assert reads == ["fast", "slow", "fast", "fast", "slow", "fast"]


def test_caught_up_table_is_not_scanned(spark, tmp_path):
    def read(name, lo, hi):
        raise AssertionError("scanned")

    loop = PollLoop(spark, [TableConfig("t", 30)], each_table(read), str(tmp_path), start_us=ZERO_US)
    loop.poll(0, ZERO_US)
    assert tuples(loop.progress(), "is_due", "rows", "next_start", "next_due") == [
        (False, 0, ZERO_US, ZERO_US + 30 * SECOND)
    ]


def test_idle_timeout(spark, tmp_path):
    loop = loop_on(
        spark, tmp_path, {"t1": micros(spark, [ZERO_US])}, start_us=ZERO_US, idle_timeout=3600
    )
    loop.tables = [TableConfig("t1", 0)]
    hours = [0.1, 0.5, 1.0, 1.5, 2.0]
    for batch_id, h in enumerate(hours):
        loop.poll(batch_id, ZERO_US + int(h * 3600 * SECOND))
    marks = [(w - ZERO_US) // SECOND for (_, w) in tuples(loop.progress(), "batch_id", "watermark")]
    # The re-read at 0.5 counts as activity; an hour later the clock takes over.
    assert marks == [0, 0, 0, 5400, 7200]


@pytest.mark.parametrize("broken", ["planned", "records", "committed"])
def test_a_failed_poll_is_repeated_with_its_plan(spark, tmp_path, monkeypatch, broken):
    rows = [(i, us, us) for i, us in enumerate([1000, 1500, 2500, 2600, 3100])]
    loop = loop_on(spark, tmp_path, {"t1": micros(spark, [us for _, us, _ in rows])}, start_us=100)
    loop.tables = [TableConfig("t1", 0)]
    loop.poll(0, 2100)
    save = loop._save

    def fail(kind, batch_id, rows):
        if broken == "planned":
            raise OSError("lost")
        if kind == "committed" and broken == "committed":
            raise OSError("lost")
        save(kind, batch_id, rows)
        if broken == "records":
            raise OSError("lost")

    monkeypatch.setattr(loop, "_save", fail)
    with pytest.raises(OSError):
        loop.poll(1, 3100)
    monkeypatch.undo()
    again = loop_on(spark, tmp_path, {"t1": micros(spark, [us for _, us, _ in rows])})
    again.tables = [TableConfig("t1", 0)]
    # The retry comes later, but keeps the plan if one was written.
    again.poll(1, 3100 if broken == "planned" else 3900)
    again.poll(1, 9999)
    again.poll(2, 4100)
    want = simulate_lookback([(us, us, us) for _, us, _ in rows], 100, 1, 0)
    s = p = 100
    for k, now in enumerate([2100, 3100, 4100]):
        seen = [us for _, us, _ in rows if (s + p) // 2 <= us < now]
        want |= {(k, us, us < s) for us in seen}
        s, p = max([s, *seen]) + 1, s
    assert set(emitted(again)) == want
    assert len(emitted(again)) == len(want)


def test_gap_in_batches_is_refused(spark, tmp_path):
    loop = loop_on(spark, tmp_path, {"t1": micros(spark, [])}, start_us=100)
    with pytest.raises(ValueError):
        loop.poll(3, 2000)


def test_fresh_loop_reads_no_history(spark, tmp_path):
    old = poll_loop.now_micros() - 10 * SECOND
    loop = loop_on(spark, tmp_path, {"t1": micros(spark, [old])})
    loop.tables = [TableConfig("t1", 0)]
    loop.poll(0)
    loop.poll(1)
    assert tuples(loop.progress(), "batch_id", "rows") == [(0, 0), (1, 0)]


def test_feed_mode(spark, tmp_path):
    feed = spark.createDataFrame(
        [("INSERT", at("00:00:01"), 7), ("DELETE", at("00:00:02"), 8)],
        "_CHANGE_TYPE string, _CHANGE_TIMESTAMP timestamp, a int",
    )
    loop = loop_on(spark, tmp_path, {"f": feed}, start_us=ZERO_US, mode="Change_Stream")
    loop.poll(0, ZERO_US + 10 * SECOND)
    assert tuples(loop.records(), "event_id", "change_type", "payload.a") == [
        ("NULL", "DELETE", 8),
        ("NULL", "INSERT", 7),
    ]


def wait_for(condition, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if condition():
            return
        time.sleep(0.5)
    raise AssertionError("nothing came")


def test_ticks_drive_the_loop_and_a_restart_goes_on(spark, tmp_path):
    frames = {"t1": micros(spark, [ZERO_US + 5 * SECOND])}
    loop = loop_on(spark, tmp_path, frames, start_us=ZERO_US)
    loop.tables = [TableConfig("t1", 0)]
    query = loop.start("5 seconds")
    wait_for(lambda: loop._load("committed", 1) is not None or query.exception())
    stop_idle(query)
    done = loop.progress().agg(F.max("batch_id")).first()[0]
    again = loop.start("5 seconds")
    wait_for(lambda: loop._load("committed", done + 1) is not None or again.exception())
    stop_idle(again)
    batches = [b for (b,) in tuples(loop.progress(), "batch_id")]
    assert batches == list(range(len(batches)))
    assert [late for _, _, late in emitted(loop)] == [False, True]


def test_multi_table_job_end_to_end(spark, tmp_path):
    source, output = str(tmp_path / "tables"), str(tmp_path / "out")
    names = [t.table_name for t in jobs.table_configs(2)]
    tables.create_tables(spark, source, names)
    now = poll_loop.now_micros()
    rows = [
        change(name, str(i), ZERO + timedelta(microseconds=now - i * SECOND - ZERO_US))
        for name in names
        for i in range(1, 4)
    ]
    tables.append_changes(change_frame(spark, rows), source)
    start = now - 60 * SECOND
    loop = jobs.multi_table(
        spark, source, output, 2, 5, start, duplicate_key=["table_name", "event_id"]
    )
    try:
        def lines():
            try:
                return spark.read.parquet(f"{output}/raw")
            except Exception:
                return None

        def ready():
            for q in spark.streams.active:
                assert not q.exception()
            found = lines()
            return found is not None and found.count() >= 12

        wait_for(ready, 120)
    finally:
        for query in spark.streams.active:
            stop_idle(query)
    found = lines().select(
        "dest",
        F.get_json_object("value", "$.event_id").alias("event_id"),
        F.get_json_object("value", "$.is_late").alias("late"),
        F.get_json_object("value", "$.is_duplicate").alias("duplicate"),
    )
    per_key = found.groupBy("dest", "event_id").agg(
        F.count_if(F.col("duplicate") == "false").alias("firsts"), F.count(F.lit(1)).alias("n")
    )
    got = tuples(per_key, "dest", "event_id", "firsts")
    assert got == [(name, str(i), 1) for name in names for i in range(1, 4)]
    assert loop.records().count() == found.count()


def test_single_table_job_end_to_end(spark, tmp_path):
    source, output = str(tmp_path / "tables"), str(tmp_path / "out")
    tables.create_tables(spark, source, ["events"])
    rows = [change("events", str(i), at(f"00:00:0{i}")) for i in range(3)]
    tables.append_changes(change_frame(spark, rows), source)
    jobs.single_table(spark, source, output, poll_interval=5, start_us=ZERO_US)
    try:
        def ready():
            for q in spark.streams.active:
                assert not q.exception()
            try:
                return publish.read_published(spark, f"{output}/files").count() >= 3
            except Exception as e:
                assert "PATH_NOT_FOUND" in str(e) or "SparkException" in type(e).__name__
                return False

        wait_for(ready, 120)
    finally:
        for query in spark.streams.active:
            stop_idle(query)
    found = publish.read_published(spark, f"{output}/files")
    assert found.count() == 3
    paths = [r.path for r in found.select("path").distinct().collect()]
    assert paths == ["events/output-20240101-000000-to-20240101-000100-00000-of-00001.json"]


@pytest.mark.parametrize("lookback", [True, False])
def test_missing_table_or_root_is_raised_and_nothing_is_lost(spark, tmp_path, lookback):
    """The poll fails, keeps its position, and reads everything once the table is there."""
    root = str(tmp_path / "tables")
    rows = change_frame(spark, [change("t1", "1", at("00:00:10")), change("t2", "2", at("00:00:20"))])
    loop = PollLoop(
        spark,
        [TableConfig("t1"), TableConfig("t2")],
        poll_loop.stored_tables(spark, root),
        str(tmp_path / "polls"),
        lookback=lookback,
        start_us=ZERO_US,
    )
    now = ZERO_US + 60_000_000
    with pytest.raises(FileNotFoundError):
        loop.poll(0, now)
    tables.append_changes(rows.filter("table_name = 't1'"), root)
    with pytest.raises(FileNotFoundError, match="t2"):
        loop.poll(0, now)
    assert loop._load("committed", 0) is None
    tables.append_changes(rows.filter("table_name = 't2'"), root)
    loop.poll(0, now)
    assert sorted(r.event_id for r in loop.records().collect()) == ["1", "2"]


def test_thousands_of_tables_in_one_scan(spark, tmp_path):
    """One condition for tables with equal days, a balanced tree for the others."""
    root = str(tmp_path / "tables")
    names = [f"t{n}" for n in range(2000)]
    for name in names:
        (tmp_path / "tables" / f"table_name={name}").mkdir(parents=True)
    tables.append_changes(change_frame(spark, [change("t7", "1", at("00:00:10"))]), root)
    day = 86_400_000_000
    began = time.monotonic()
    polls = [(n, ZERO_US - (k % 300) * day, ZERO_US + day) for k, n in enumerate(names)]
    assert [r.event_id for r in tables.scan_tables(spark, root, polls).collect()] == ["1"]
    assert time.monotonic() - began < 30


def test_day_patterns():
    _days = tables._days

    day = 86_400_000_000
    assert _days(ZERO_US, ZERO_US + day) == "change_date={2024-01-01}"
    assert _days(ZERO_US, ZERO_US + 32 * day) == "change_date={2024-01-*,2024-02-01}"
    assert _days(ZERO_US - day, ZERO_US + 366 * day) == "change_date={2023-12-31,2024-*}"
    assert len(_days(0, ZERO_US + 40 * day).split(",")) < 70


def test_old_commits_are_folded(spark, tmp_path, monkeypatch):
    """Progress is the same as without folding; the commits a restart needs stay as they are."""
    monkeypatch.setattr(poll_loop, "FOLD", 2)
    positions = {"t1": micros(spark, [100 * k + 50 for k in range(6)])}
    loop = loop_on(spark, tmp_path / "a", positions, start_us=0)
    for batch_id in range(5):
        loop.poll(batch_id, 100 * batch_id + 100)
        if batch_id == 3:
            # A new process goes on where the last one was.
            loop = loop_on(spark, tmp_path / "a", positions, start_us=0)
    loop.tables = [TableConfig("t1", 0)]
    left = sorted(p.name for p in (tmp_path / "a" / "committed").glob("batch=*"))
    assert left == ["batch=2", "batch=3", "batch=4"] and (tmp_path / "a" / "folded" / "upto=1").is_dir()
    assert not (tmp_path / "a" / "planned" / "batch=0").exists()
    monkeypatch.setattr(poll_loop, "FOLD", 99)
    whole = loop_on(spark, tmp_path / "b", positions, start_us=0)
    for batch_id in range(5):
        whole.poll(batch_id, 100 * batch_id + 100)
    columns = ["batch_id", "start", "prev_start", "rows", "next_start", "watermark"]
    assert tuples(loop.progress(), *columns) == tuples(whole.progress(), *columns)
    assert loop.progress().count() == 5


def test_rows_lost_behind_the_write_are_noticed(spark, tmp_path, monkeypatch):
    loop = loop_on(spark, tmp_path, {"t1": micros(spark, [50, 60])}, start_us=0)
    monkeypatch.setattr(poll_loop.Observation, "get", property(lambda self: {"rows": 3}))
    with pytest.raises(OSError, match="3 rows"):
        loop.poll(0, 100)


def test_stored_feeds_list_the_days_of_a_range(spark, tmp_path, monkeypatch):
    rows = [("INSERT", at(f"{24 * d:02}:00:10"), d, "x") for d in range(4)]
    ddl = "_CHANGE_TYPE string, _CHANGE_TIMESTAMP timestamp, number long, note string"
    root, day = str(tmp_path), 86_400 * SECOND
    tables.write_feed(spark.createDataFrame(rows, ddl), root, "feed")
    tables.write_feed(spark.createDataFrame(rows[:1], ddl), root, "other")
    spark.createDataFrame(rows, ddl).write.parquet(tables.table_path(root, "plain"))
    stored = tables.StoredFeeds(spark, root)
    got = stored.read("feed", ZERO_US + day, ZERO_US + 3 * day)
    assert got.columns == ["_CHANGE_TYPE", "_CHANGE_TIMESTAMP", "number", "note"]
    assert tuples(got, "number") == [(1,), (2,)]
    assert len({p.split("/change_date=")[1][:10] for p in got.inputFiles()}) == 2
    assert stored.read("feed", ZERO_US - 9 * day, ZERO_US - 8 * day).count() == 0
    assert stored.read("plain", ZERO_US, ZERO_US + 1).count() == 4
    # The schema is looked up once; the rest of the history is never listed again.
    monkeypatch.setattr(tables, "folder_names", lambda *_: (_ for _ in ()).throw(AssertionError("listed")))
    assert tuples(stored.read("feed", ZERO_US, ZERO_US + day), "number") == [(0,)]
    monkeypatch.undo()
    with pytest.raises(FileNotFoundError):
        stored.read("missing", 0, 1)
