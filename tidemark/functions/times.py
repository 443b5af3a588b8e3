"""Positions are UTC microseconds since the epoch; these functions convert to and from them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISION = 1_000_000


def to_micros(ts: Column) -> Column:
    """Timestamp (with or without zone, session in UTC) to microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def micros_to_seconds(us: Column) -> Column:
    return us / F.lit(float(PRECISION))


def seconds_to_micros(seconds: Column) -> Column:
    """Truncates; `to_micros` is exact and preferred where a timestamp is at hand."""
    return (seconds * PRECISION).cast("long")


def micros_text(us: Column) -> Column:
    """`2024-01-01 00:00:07.179575`, always six digits."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def iso_text(ts: Column, separator: str = "T") -> Column:
    """ISO-8601 with offset; the fraction is left out when it is zero."""
    ts = ts.cast("timestamp")
    whole = f"yyyy-MM-dd'{separator}'HH:mm:ss"
    return F.when(
        F.unix_micros(ts) % PRECISION == 0, F.date_format(ts, f"{whole}xxx")
    ).otherwise(F.date_format(ts, f"{whole}.SSSSSSxxx"))


def text_to_micros(text: Column) -> Column:
    return F.unix_micros(F.to_timestamp(text))


def window_text(ts: Column) -> Column:
    """`20240101-000100`, the form used in output names."""
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def micros_window_text(us: int) -> str:
    """The same for a position in the driver, rounded down to the second."""
    return (datetime(1970, 1, 1) + timedelta(seconds=us // PRECISION)).strftime("%Y%m%d-%H%M%S")


def window_name(window: Column) -> Column:
    """`20240101-000000-to-20240101-000100` for a window struct."""
    return F.concat(window_text(window["start"]), F.lit("-to-"), window_text(window["end"]))


def midpoint(a: Column, b: Column) -> Column:
    """Floor of the mean, as an arithmetic shift so that it also floors below zero."""
    return F.shiftright(a + b, 1)


def poll_index(position: Column, start_us: int, step_us: int) -> Column:
    """Number of the poll covering `position`, which must not lie before `start_us`."""
    return F.call_function("div", position - F.lit(start_us), F.lit(step_us))
