"""Append JSON lines to change tables, batch by batch, and report the lines that are no changes.

A batch is written aside, good rows by table and day and bad lines with the reason, then its plan: which file goes
where. Only then are files moved to the tables and to the rejects. A batch that is repeated goes on from its plan,
or is written aside again if it had none, so its rows are appended once, all or none of them planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.schema import CHANGE_COLUMNS, PARTITION_DAY
from tidemark.session import folder_exists, folder_names, mark_done, matching_paths, move_files, remove_paths
from tidemark.sources.tables import parse_change_lines

APPENDS, REJECTS = "_appends", "_rejects"
REJECT_DDL = "table_name string, value string, reason string, batch long"
NO_JSON, NO_TIME, NO_TABLE = "no change record", "no timestamp", "no such table"
STORED = "stored"


def sorted_out(lines: DataFrame, tables: list[str]) -> tuple[DataFrame, DataFrame]:
    """Changes that can be appended to `tables`, and the other lines with the reason why not."""
    here = F.coalesce(F.col("table_name").isin(tables), F.lit(False)) if tables else F.lit(False)
    good, bad = parse_change_lines(lines.where(here))
    stamped = F.col("change_timestamp").isNotNull()
    rejected = lines.where(~here).select("table_name", "value", F.lit(NO_TABLE).alias("reason"))
    rejected = rejected.unionByName(bad.select("table_name", "value", F.lit(NO_JSON).alias("reason")))
    # The line itself is kept, whatever was made of it.
    late = good.where(~stamped).select("table_name", F.to_json(F.struct(*CHANGE_COLUMNS)).alias("value"))
    rejected = rejected.unionByName(late.withColumn("reason", F.lit(NO_TIME)))
    return good.where(stamped), rejected


def append_lines(lines: DataFrame, root: str, batch_id: int) -> None:
    """Append a batch of lines (`value`, `table_name`) to the tables under `root`.

    Rejected lines go to `<root>/_rejects`. A batch that was appended before is passed over.
    """
    spark, root = lines.sparkSession, root.rstrip("/")
    folder = f"{root}/{APPENDS}/batch={batch_id}"
    if folder_exists(spark, f"{folder}/_DONE"):
        return
    if not folder_exists(spark, f"{folder}/plan/_SUCCESS"):
        names = folder_names(spark, root)
        tables = sorted(n.removeprefix("table_name=") for n in names if n.startswith("table_name="))
        good, bad = sorted_out(lines, tables)
        day = F.to_date("change_timestamp").alias(PARTITION_DAY)
        for rows, name, by in (
            (good.select(*CHANGE_COLUMNS, "table_name", day), "rows", ["table_name", PARTITION_DAY]),
            (bad.withColumn("batch", F.lit(batch_id).cast("long")), "rejects", ["batch"]),
        ):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(f"{folder}/{name}")
        moves = [(p, _place(p, f"{folder}/rows", root, batch_id)) for p in matching_paths(spark, f"{folder}/rows/*/*/part-*")]
        moves += [
            (p, _place(p, f"{folder}/rejects", f"{root}/{REJECTS}", batch_id))
            for p in matching_paths(spark, f"{folder}/rejects/*/part-*")
        ]
        plan = spark.createDataFrame(moves, "source string, path string")
        plan.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{folder}/plan")
    plan = spark.read.schema("source string, path string").parquet(f"{folder}/plan")
    move_files(spark, [tuple(r) for r in plan.collect()])
    mark_done(spark, f"{folder}/_DONE")
    remove_paths(spark, [f"{folder}/rows", f"{folder}/rejects"])


def _place(path: str, aside: str, target: str, batch_id: int) -> str:
    """Where a file that was written aside belongs; the batch is part of its name."""
    inner = path.split(aside.split(":", 1)[-1], 1)[1]
    folder, name = inner.rsplit("/", 1)
    return f"{target}{folder}/{name.replace('part-', f'part-{batch_id}-', 1)}"


def rejected_lines(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, value, reason, batch): all lines that were rejected so far."""
    path = f"{root.rstrip('/')}/{REJECTS}"
    if not folder_exists(spark, path):
        return spark.createDataFrame([], REJECT_DDL)
    return spark.read.schema(REJECT_DDL).parquet(path)


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines under `<path>/table_name=<name>/` as a stream."""
    reader = spark.readStream.schema("value string, table_name string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def append_stream(lines: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream of lines, each batch once."""
    return (
        lines.writeStream.foreachBatch(lambda rows, batch_id: append_lines(rows, root, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
