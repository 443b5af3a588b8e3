"""Rows of a change table to uniform change records, and records to JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import iso_text, to_micros
from tidemark.schema import MISSING_CHANGE_TYPE, MISSING_EVENT_ID, RECORD_FIELDS


def to_records(
    changes: DataFrame, table_name: str | None = None, start_us: int | Column | None = None
) -> DataFrame:
    """Shape scanned rows into change records, with `event_time` and `us` beside the fields.

    A column the source lacks gets its default; a NULL in a column it has stays NULL.
    `start_us` is the position the poll started from: older rows are late.
    """
    have = set(changes.columns)
    event_id = F.col("event_id") if "event_id" in have else F.lit(MISSING_EVENT_ID)
    change_type = F.col("change_type") if "change_type" in have else F.lit(MISSING_CHANGE_TYPE)
    payload = (
        F.col("payload") if "payload" in have else F.create_map().cast("map<string,string>")
    )
    table = F.lit(table_name) if table_name is not None else F.col("table_name")
    us = to_micros(F.col("change_timestamp"))
    if start_us is None:
        late = F.col("is_late") if "is_late" in have else F.lit(False)
    else:
        late = us < (start_us if isinstance(start_us, Column) else F.lit(start_us))
    return changes.select(
        event_id.alias("event_id"),
        change_type.alias("change_type"),
        iso_text(F.col("change_timestamp")).alias("change_timestamp"),
        table.alias("table_name"),
        payload.alias("payload"),
        late.alias("is_late"),
        F.lit(False).alias("is_duplicate"),
        F.col("change_timestamp").cast("timestamp").alias("event_time"),
        us.alias("us"),
    )


def _json_ready(value: Column, kind: T.DataType) -> Column:
    """Timestamps inside a struct or array become text, with a space before the time."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(value, " ")
    if isinstance(kind, T.StructType) and kind.fields:
        fields = [_json_ready(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _json_ready(v, kind.elementType))
    return value


def json_line(df: DataFrame, fields: list[str] | None = None) -> Column:
    """One JSON object per row; NULL fields are written as null."""
    fields = fields or [c for c in RECORD_FIELDS if c in df.columns]
    values = []
    for name in fields:
        kind = df.schema[name].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            values.append(iso_text(F.col(name)).alias(name))
        else:
            values.append(_json_ready(F.col(name), kind).alias(name))
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def change_key_text() -> Column:
    """`<change type>-<order id, or event id if empty>-<timestamp>` of a change record."""
    order_id = F.col("payload.order_id")
    entity = F.coalesce(F.when(order_id != "", order_id), F.col("event_id"))
    return F.concat_ws(
        "-",
        F.coalesce(F.col("change_type"), F.lit("None")),
        F.coalesce(entity, F.lit("None")),
        F.col("change_timestamp"),
    )


def entity_key_text() -> Column:
    """`<table>:<event id>`, the text form of the default duplicate key."""
    return F.concat_ws(":", F.col("table_name"), F.coalesce(F.col("event_id"), F.lit("None")))
