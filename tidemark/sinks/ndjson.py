"""Write change records as newline-delimited JSON under `dest=<table>/win=<window>/`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.records import json_line
from tidemark.functions.times import window_text
from tidemark.operators.groups import attach_facts
from tidemark.operators.windows import with_destination
from tidemark.schema import WINDOW_SECONDS
from tidemark.session import PLAIN_FILES, listed_in_blocks, stage, write_tasks

PLACE = ["dest", "win"]
STORED_DDL = "value string, dest string, win string"
# Above this many rows a window of a table is written as several files.
MAX_ROWS_PER_FILE = 5_000_000


def write_lines(
    rows: DataFrame, path: str, fields: list[str] | None = None, mode: str = "append"
) -> None:
    """All rows as JSON lines under one prefix, without regard to table or window."""
    rows.select(json_line(rows, fields).alias("value")).write.mode(mode).text(path)


def output_name(
    window: Column, shard: Column, shards: Column, table: Column | None = None
) -> Column:
    """`<table>/output-<start>-to-<end>-00000-of-00001.json`."""
    name = F.concat(
        F.lit("output-"),
        window_text(window["start"]),
        F.lit("-to-"),
        window_text(window["end"]),
        F.format_string("-%05d-of-%05d.json", shard, shards),
    )
    return name if table is None else F.concat_ws("/", table, name)


def placed_lines(
    records: DataFrame,
    event_time: str = "event_time",
    seconds: int = WINDOW_SECONDS,
    fields: list[str] | None = None,
) -> DataFrame:
    """Records as `value`, `dest` and `win`, to be written as they come, without a shuffle."""
    lines = records.withColumn("value", json_line(records, fields))
    return with_destination(lines, event_time, seconds).select("value", *PLACE)


def sharded(
    rows: DataFrame, max_rows_per_file: int = MAX_ROWS_PER_FILE, **attach: int
) -> tuple[DataFrame, int]:
    """Rows with `_shard` and `_shards`, and the number of tasks that write them.

    A window (`win`) of a table (`dest`) with more than `max_rows_per_file` rows is cut into shards of
    about that size, so no task has to take a window of unbounded size.
    """
    groups = stage(rows.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_rows")), "groups")
    total = groups.agg(F.sum("_rows")).first()[0] or 0
    large = groups.filter(F.col("_rows") > max_rows_per_file)
    known = attach_facts(rows, large, PLACE, "_rows", **attach)
    shards = F.coalesce(F.ceil(F.col("_rows") / max_rows_per_file), F.lit(1).cast("long"))
    # The task number spreads equal rows too, and is the same when a task is run again.
    own = "value" if "value" in rows.columns else "event_time"
    spread = F.pmod(F.xxhash64(own) + F.spark_partition_id(), shards)
    cut = known.select(*rows.columns, spread.alias("_shard"), shards.alias("_shards"))
    return cut, max(write_tasks(rows.sparkSession), total // max_rows_per_file)


def one_file_per_window(
    rows: DataFrame, max_rows_per_file: int = MAX_ROWS_PER_FILE, **attach: int
) -> DataFrame:
    """Shuffle so that a window (`win`) of a table (`dest`) ends up in one task, for one file.

    `max_rows_per_file` is the size limit of a file, in rows (default `MAX_ROWS_PER_FILE`). Larger windows
    have one file per shard.
    """
    cut, tasks = sharded(rows, max_rows_per_file, **attach)
    return (
        cut.repartition(tasks, *PLACE, "_shard")
        .sortWithinPartitions(*PLACE, *[c for c in ("event_time",) if c in rows.columns])
        .select(*rows.columns)
    )


def write_windows(
    rows: DataFrame,
    path: str,
    mode: str = "append",
    fields: list[str] | None = None,
    **options: int,
) -> None:
    """Write rows that have `dest` and `win`, one file for both, larger windows in shards.

    Records become JSON lines after the shuffle, which moves them in their shorter form; rows
    with a `value` are lines already.
    """
    gathered = one_file_per_window(rows, **options)
    line = F.col("value") if "value" in rows.columns else json_line(rows, fields)
    gathered.select(line.alias("value"), *PLACE).write.mode(mode).options(
        partitionOverwriteMode="dynamic", **PLAIN_FILES
    ).partitionBy(*PLACE).text(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """The lines under `path` with their `dest` and `win`."""
    with listed_in_blocks(spark):
        return spark.read.schema(STORED_DDL).text(path)


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and lengths of the files under `path`; their contents are not read."""
    with listed_in_blocks(spark):
        found = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "part-*")
            .load(path)
        )
    return found.select("path", "length")
