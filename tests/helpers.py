"""Small inputs and step-by-step simulations to compare with."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import CHANGE_DDL

ZERO = datetime(2024, 1, 1, tzinfo=timezone.utc)
ZERO_US = 1_704_067_200_000_000
CHANGES = f"table_name string, {CHANGE_DDL}"


def at(text: str) -> datetime:
    """`00:01:02.5` on the first day."""
    h, m, s = text.split(":")
    return ZERO + timedelta(hours=int(h), minutes=int(m), seconds=float(s))


def change(table: str, event_id: str | None, ts: datetime | None, kind: str = "INSERT") -> tuple:
    return table, event_id, kind, (f"o-{event_id}", "u-1", 1.5, ts, ts), ts


def change_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CHANGES)


def position_frame(spark: SparkSession, rows: list[tuple[str, int, int, int]]) -> DataFrame:
    """Rows of (table, id, us, arrival_us)."""
    return spark.createDataFrame(rows, "table_name string, id long, us long, arrival_us long")


def simulate_lookback(rows, start: int, step: int, polls: int) -> set[tuple]:
    """(id, poll, is_late) of everything lookback polls emit; rows are (id, us, arrival)."""
    s = p = start
    out = set()
    for k in range(polls):
        target = start + (k + 1) * step
        if s >= target:
            continue
        floor = (s + p) // 2
        seen = [(i, us) for i, us, arrival in rows if arrival < target and floor <= us < target]
        if not seen:
            continue
        out |= {(i, k, us < s) for i, us in seen}
        s, p = max([s, *[us for _, us in seen]]) + 1, s
    return out


def simulate_contiguous(rows, start: int, step: int, polls: int) -> set[tuple]:
    out = set()
    for k in range(polls):
        lo, hi = start + k * step, start + (k + 1) * step
        out |= {(i, k) for i, us, arrival in rows if lo <= us < hi and arrival < hi}
    return out


def tuples(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted(tuple(r) for r in df.select(*columns).collect())


def with_us(df: DataFrame) -> DataFrame:
    return df.withColumn("us", F.unix_micros("change_timestamp"))
