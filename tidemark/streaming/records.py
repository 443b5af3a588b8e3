"""The poll loop's records as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.schema import PAYLOAD_DDL

RECORD_DDL = (
    f"event_id string, change_type string, change_timestamp string, payload {PAYLOAD_DDL}, "
    "is_late boolean, is_duplicate boolean, event_time timestamp, us long, table_name string"
)


def create_records(
    spark: SparkSession, path: str, schema: str | T.StructType = RECORD_DDL
) -> None:
    """Make the folder of the records, so that a stream can start before the first poll."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")


def stream_records(
    spark: SparkSession, path: str, schema: str | T.StructType = RECORD_DDL
) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
