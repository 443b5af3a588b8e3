"""The given tables seen as change tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import to_micros
from tidemark.schema import FEED_TIMESTAMP, FEED_TYPE

TABLES = [f"events_{n}" for n in range(1, 5)]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same files as a stream. The brackets make the path a pattern, which a stream needs
    to accept a single file."""
    schema = load(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


def as_changes(events: DataFrame) -> DataFrame:
    """`events` as the changes of four tables; the user is the entity that changes."""
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("user_id").cast("string").alias("event_id"),
        F.when(F.col("event_type") == "signup", "INSERT")
        .when(F.col("event_type") == "error", "DELETE")
        .otherwise("UPDATE")
        .alias("change_type"),
        F.struct(
            F.concat(F.lit("o-"), F.col("event_id")).alias("order_id"),
            F.concat(F.lit("u-"), F.col("user_id") % 100).alias("user_id"),
            F.col("value").alias("price"),
            ts.alias("created_at"),
            ts.alias("updated_at"),
        ).alias("payload"),
        ts.alias("change_timestamp"),
        F.concat(F.lit("events_"), F.col("event_id") % 4 + 1).alias("table_name"),
        to_micros(F.col("ts")).alias("us"),
        (to_micros(F.col("ts")) + F.col("event_id") * 7919 % 7200 * 1_000_000).alias("arrival_us"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of all four tables, without arrival times."""
    return as_changes(load(spark, sf_dir, "events")).drop("arrival_us")


def delayed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that arrive up to two hours after their own time."""
    return as_changes(load(spark, sf_dir, "events"))


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as one change table."""
    ts = F.col("o_orderdate").cast("timestamp")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("event_id"),
        _order_change().alias("change_type"),
        F.struct(
            F.concat(F.lit("o-"), F.col("o_orderkey")).alias("order_id"),
            F.concat(F.lit("u-"), F.col("o_custkey")).alias("user_id"),
            F.col("o_totalprice").alias("price"),
            ts.alias("created_at"),
            ts.alias("updated_at"),
        ).alias("payload"),
        ts.alias("change_timestamp"),
    )


def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as one change table."""
    ts = F.col("l_shipdate").cast("timestamp")
    return load(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"),
        F.when(F.col("l_linestatus") == "O", "INSERT").otherwise("UPDATE").alias("change_type"),
        F.struct(
            F.concat(F.lit("o-"), F.col("l_orderkey")).alias("order_id"),
            F.concat(F.lit("u-"), F.col("l_suppkey")).alias("user_id"),
            F.col("l_extendedprice").alias("price"),
            ts.alias("created_at"),
            ts.alias("updated_at"),
        ).alias("payload"),
        ts.alias("change_timestamp"),
    )


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as a change feed: metadata columns and the table's own columns."""
    orders = load(spark, sf_dir, "orders")
    return orders.select(
        _order_change().alias(FEED_TYPE),
        F.col("o_orderdate").alias(FEED_TIMESTAMP),
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        "o_orderpriority",
    )


def _order_change():
    status = F.col("o_orderstatus")
    return F.when(status == "O", "INSERT").when(status == "P", "UPDATE").otherwise("DELETE")
