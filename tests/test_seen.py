"""Flags from a table of seen keys are the flags of the batch operator."""

import random
from collections import Counter
from pathlib import Path

import pytest

from tests.helpers import at, change, change_frame, with_us
from tidemark.operators import duplicates as batch
from tidemark.sources import tables
from tidemark.streaming import seen
from tidemark.streaming.windows import union_streams

DDL = "table_name string, event_id string, us long"
KEYS = ["table_name", "event_id"]


def random_batches(rng, n, size):
    keys = ["hot", None, *map(str, range(60))]
    out, us = [], 0
    for _ in range(n):
        rows = []
        for _ in range(size):
            us += rng.randint(0, 2)
            rows.append((rng.choice(["t1", "t2", None]), "hot" if rng.random() < 0.3 else rng.choice(keys), us))
        out.append(rows)
        us += 1
    return out


def flagged(spark, store, batches, start=0):
    out = Counter()
    for k, rows in enumerate(batches, start):
        df = spark.createDataFrame(rows, DDL)
        out.update(map(tuple, seen.flag_batch(store, df, k).collect()))
    return out


def wanted(spark, batches):
    every = spark.createDataFrame([r for rows in batches for r in rows], DDL)
    return Counter(map(tuple, batch.flag_duplicates(every, KEYS).collect()))


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_random_batches(spark, tmp_path, bits):
    """With a filter that works and with one whose bits are all set; generations are merged on the way."""
    batches = random_batches(random.Random(bits), 5, 60)
    store = seen.SeenKeys(spark, str(tmp_path), KEYS, buckets=8, filter_bits=bits, fan_in=2)
    assert flagged(spark, store, batches) == wanted(spark, batches)
    generations = store._generations(99)
    assert len(generations) < 4 and any(lo < hi for lo, hi, _ in generations)
    total = {tuple(r[:2]) for rows in batches for r in rows}
    assert sum(rows for *_, rows in generations) == len(total)


def test_restart_and_repeated_batches(spark, tmp_path):
    batches = random_batches(random.Random(5), 4, 30)

    def store():
        return seen.SeenKeys(spark, str(tmp_path), KEYS, fan_in=2)

    first = flagged(spark, store(), batches[:3])
    # The last batch again, by a new process, and then the others.
    again = flagged(spark, store(), batches[2:3], 2)
    assert not again - first
    rest = flagged(spark, store(), batches[3:], 3)
    assert first + rest == wanted(spark, batches)


def test_batches_of_new_keys_open_nothing(spark, tmp_path):
    store = seen.SeenKeys(spark, str(tmp_path), KEYS)
    rows = [[("t", f"{b}-{k}", b * 100 + k) for k in range(50)] for b in range(3)]
    for b, own in enumerate(rows):
        got = seen.flag_batch(store, spark.createDataFrame(own, DDL), b).collect()
        assert not any(r.is_duplicate for r in got) and store.opened == 0
    got = seen.flag_batch(store, spark.createDataFrame([("t", "0-7", 900), ("t", "new", 901)], DDL), 3).collect()
    assert {(r.event_id, r.is_duplicate) for r in got} == {("0-7", True), ("new", False)} and store.opened == 1
    assert seen.flag_batch(store, spark.createDataFrame([], DDL), 4).count() == 0
    got = seen.flag_batch(store, spark.createDataFrame([("t", "new", 950)], DDL), 5).collect()
    assert [r.is_duplicate for r in got] == [True]


def test_old_generations_go(spark, tmp_path):
    store = seen.SeenKeys(spark, str(tmp_path), KEYS, fan_in=2)
    flagged(spark, store, random_batches(random.Random(6), 4, 10))
    assert len(list(Path(tmp_path).glob("keys/gen=*"))) <= 6
    assert len(list(Path(tmp_path).glob("commits/batch=*"))) == 2


def test_stream_over_several_starts(spark, tmp_path):
    rng = random.Random(1)
    root, rows = f"{tmp_path}/tables", []
    tables.create_tables(spark, root, ["t1", "t2"])
    for n in range(3):
        some = [
            change(rng.choice(["t1", "t2"]), rng.choice(["hot", str(rng.randrange(40)), None]), at(f"00:{n:02}:{i % 60:02}.{i:06}"))
            for i in range(150)
        ]
        rows += some
        tables.append_changes(change_frame(spark, some).coalesce(1), root)
        both = union_streams([tables.stream_table(spark, root, t) for t in ("t1", "t2")])
        seen.flag_stream(with_us(both).select(*KEYS, "us"), f"{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/rows").drop("batch")
    plain = with_us(change_frame(spark, rows)).select(*KEYS, "us")
    want = batch.flag_duplicates(plain)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_filter_must_be_a_power_of_two(spark, tmp_path):
    with pytest.raises(ValueError):
        seen.SeenKeys(spark, str(tmp_path), KEYS, filter_bits=100)
