"""Duplicate flag and duplicate removal on bounded data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.groups import attach_facts, number_copies
from tidemark.schema import MISSING_EVENT_ID
from tidemark.session import stage

# The default marks every later change of an entity; the second marks only re-reads of a change.
ENTITY_KEY = ["table_name", "event_id"]
CHANGE_KEY = ["table_name", "event_id", "change_type", "change_timestamp"]


def check_key(keys: list[str], feed: bool) -> None:
    """A change feed has no event ids: under the default key all its rows would be one entity."""
    if feed and "event_id" in keys and "change_timestamp" not in keys:
        raise ValueError(
            f"rows of a change feed all have the event id {MISSING_EVENT_ID!r}; "
            "choose a key that tells them apart"
        )


def flag_duplicates(
    rows: DataFrame,
    keys: list[str] = ENTITY_KEY,
    order_by: list[str] | None = None,
    row_id: list[str] | None = None,
    **attach: int,
) -> DataFrame:
    """Set `is_duplicate`: false on the first row of a key in `order_by`, true on the others.

    `row_id` are columns that tell apart rows equal in keys and order. Without it every column
    serves, and equal rows are numbered first, at the price of a grouping over all columns.

    Only the first position per key is computed, by a grouping that combines before the shuffle and,
    as positions have a fixed width, needs no sort. It is brought back to the rows; only keys with several
    rows at their first position are looked at once more. No task ever holds all rows of a key.
    """
    order_by = order_by or ["us"]
    columns = [c for c in rows.columns if c != "is_duplicate"]
    rows = rows.select(*columns)
    if row_id is None:
        rows = number_copies(rows, "_copy")
        row_id = [*[c for c in columns if c not in keys and c not in order_by], "_copy"]
    time, rest = order_by[0], [*order_by[1:], *row_id]
    # As in any order here, NULL comes first.
    none = F.max(F.col(time).isNull())
    firsts = (
        rows.groupBy(*keys)
        .agg(
            F.when(~none, F.min(time)).alias("_first"),
            F.count(F.lit(1)).alias("_n"),
        )
        .filter(F.col("_n") > 1)
    )
    known = attach_facts(rows, firsts, keys, "_n", **attach)
    at_first = F.col("_n").isNotNull() & F.col(time).eqNullSafe(F.col("_first"))
    ahead = known.filter(at_first)
    tied = ahead.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t")).filter(F.col("_t") > 1)
    tied = stage(tied, "tied")
    repeated = F.col("_n").isNotNull() & ~at_first
    if not tied.isEmpty():
        place = F.struct(*rest)
        few = attach_facts(ahead, tied, keys, "_t", **attach).filter(F.col("_t").isNotNull())
        least = few.groupBy(*keys).agg(
            F.min(place).alias("_least"), F.count(F.lit(1)).alias("_t")
        )
        known = attach_facts(known, least, keys, "_t", **attach)
        behind = F.col("_t").isNotNull() & ~place.eqNullSafe(F.col("_least"))
        repeated = repeated | (at_first & behind)
    return known.select(*columns, repeated.alias("is_duplicate"))


def drop_duplicates(rows: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The first row of every key. Combines before the shuffle, so hot keys do no harm."""
    rest = [c for c in rows.columns if c not in keys and c not in order_by]
    kept = rows.groupBy(*keys).agg(F.min(F.struct(*order_by, *rest)).alias("_row"))
    return kept.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])
