"""Column names and types shared by sources, operators and sinks."""

from __future__ import annotations

from typing import NamedTuple

# Fields and types of change rows and records, as sources and readers expect them.
PAYLOAD_DDL = (
    "struct<order_id: string, user_id: string, price: double, "
    "created_at: timestamp, updated_at: timestamp>"
)
CHANGE_DDL = (
    f"event_id string, change_type string, payload {PAYLOAD_DDL}, change_timestamp timestamp"
)
CHANGE_COLUMNS = ["event_id", "change_type", "payload", "change_timestamp"]

# Field order of a change record; it is also the order in the JSON line.
RECORD_FIELDS = [
    "event_id",
    "change_type",
    "change_timestamp",
    "table_name",
    "payload",
    "is_late",
    "is_duplicate",
]

# Defaults for columns a source does not have.
MISSING_EVENT_ID = "NULL"
MISSING_CHANGE_TYPE = "UNKNOWN"

# Cadence, window and watermark settings.
POLL_INTERVAL_SECONDS = 30
WINDOW_SECONDS = 60
WATERMARK_LAG_SECONDS = 30
INITIAL_WATERMARK_LAG_SECONDS = 300

# Metadata columns of a change feed.
FEED_TYPE = "_CHANGE_TYPE"
FEED_TIMESTAMP = "_CHANGE_TIMESTAMP"

PARTITION_DAY = "change_date"


class TableConfig(NamedTuple):
    """One change table and how often it is polled. The fields and the default."""

    table_name: str
    poll_interval: int = POLL_INTERVAL_SECONDS
