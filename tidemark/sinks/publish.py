"""Closed windows as files with names of their own, from many small raw files.

Raw rows (`value`, `dest`, `win`) lie in a store of Parquet files by the hour in which their window ends
(`write_raw`, `stream_raw`), or as text by `dest` and `win`. A run takes the windows that have ended
by a given time and writes each as `<dest>/output-<start>-to-<end>-<shard>-of-<shards>.json`.

* The raw files known so far are remembered (`_known`). A run opens only files it doesn't know, and of the known ones
  those of the hours between the last run's time and its own; rows of the others are all published.
* A late row makes its window be written again: what the window's files hold, plus the new rows. Raw files that
  were published can therefore be removed at any time.
* A run writes its files aside, then its plan: which file goes where, and which go away. Only then are files moved.
  A run that was cut off before the plan leaves nothing; one that was cut off later is finished by the
  next run from its plan. So every row is published once.
* `_files` lists all published files by day and run.

The driver holds the names of the files that a run reads and writes, as Spark does when it commits a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.session import (
    PLAIN_FILES,
    cleared,
    folder_exists,
    folder_names,
    listed_in_blocks,
    mark_done,
    matching_paths,
    move_files,
    remove_paths,
    stage,
    write_tasks,
)
from tidemark.sinks.ndjson import MAX_ROWS_PER_FILE, PLACE, STORED_DDL, sharded, written_files

RAW_DDL = f"{STORED_DDL}, ends string"
KNOWN, FILES, RUNS, ATTEMPT = "_known", "_files", "_runs", "_attempt"
PLAN_DDL = (
    "run long, day string, dest string, win string, shard long, shards long, "
    "source string, path string, rows long, state string"
)
# Plan rows: a file that is moved to its place, or an older one that goes away.
_PUT, _GONE = "put", "gone"
# Input tasks whose rows of an hour share a raw file.
TASKS_PER_FILE = 8
_HOUR = 11  # characters of `20240101-00`


def window_end(win: Column | str) -> Column:
    """`20240101-000100` of `20240101-000000-to-20240101-000100`."""
    return F.substring_index(win, "-to-", -1)


def with_hour(lines: DataFrame) -> DataFrame:
    return lines.select("value", *PLACE, F.substring(window_end("win"), 1, _HOUR).alias("ends"))


def write_raw(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Add lines (`value`, `dest`, `win`) to a raw store, a file per hour and `TASKS_PER_FILE` input tasks.

    The hours are dealt over tasks, so that no task opens the files of all of them.
    """
    # The task number is the same when a task is run again.
    group = F.call_function("div", F.spark_partition_id(), F.lit(TASKS_PER_FILE))
    dealt = with_hour(lines).withColumn("_group", group)
    dealt = dealt.repartition(write_tasks(lines.sparkSession), "ends", "_group").drop("_group")
    dealt.write.mode(mode).options(**PLAIN_FILES).partitionBy("ends").parquet(path)


def stream_raw(lines: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The same from a stream, each row exactly once."""
    return (
        with_hour(lines).writeStream.format("parquet")
        .partitionBy("ends")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


class _Raw:
    """The raw files under a folder, in either layout."""

    def __init__(self, spark: SparkSession, source: str):
        names = folder_names(spark, source)
        self.spark, self.source = spark, source
        self.by_hour = any(n.startswith("ends=") for n in names)
        self.empty = not self.by_hour and not any(n.startswith("dest=") for n in names)

    def files(self) -> DataFrame:
        """(path, ends): names only; contents are not read. Committed files only if a stream wrote them."""
        if self.empty:
            return self.spark.createDataFrame([], "path string, ends string")
        with listed_in_blocks(self.spark):
            files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(self.source)
        hour = F.col("ends").cast("string") if self.by_hour else F.substring(window_end("win"), 1, _HOUR)
        return files.select("path", hour.alias("ends"))

    def rows(self, paths: list[str]) -> DataFrame:
        read = self.spark.read.option("basePath", self.source)
        if not paths:
            return self.spark.createDataFrame([], STORED_DDL)
        with listed_in_blocks(self.spark):
            if self.by_hour:
                return read.schema(RAW_DDL).parquet(*paths).select("value", *PLACE)
            return read.schema(STORED_DDL).text(paths)


def _last_run(spark: SparkSession, target: str) -> int:
    """Number of the last run that has a plan; -1 if there is none."""
    found = matching_paths(spark, f"{target}/{RUNS}/run=*/_SUCCESS")
    return max((int(p.rsplit("/", 2)[1].removeprefix("run=")) for p in found), default=-1)


def _finish(spark: SparkSession, target: str, run: int) -> None:
    """Move the files of a run's plan to their places, list them, and mark the run as published."""
    folder = f"{target}/{RUNS}/run={run}"
    if folder_exists(spark, f"{folder}/_PUBLISHED"):
        return
    plan = spark.read.schema(PLAN_DDL).parquet(folder)
    rows = plan.select("state", "source", "path").collect()
    move_files(spark, [(r["source"], f"{target}/{r['path']}") for r in rows if r["state"] == _PUT])
    remove_paths(spark, [f"{target}/{r['path']}" for r in rows if r["state"] == _GONE])
    put = plan.where(F.col("state") == _PUT).select("dest", "win", "shard", "shards", "path", "rows", "day", "run")
    if rows:
        put.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run").parquet(
            f"{target}/{FILES}"
        )
    mark_done(spark, f"{folder}/_PUBLISHED")
    remove_paths(spark, [f"{target}/{ATTEMPT}"])


def published_files(spark: SparkSession, target: str, days: list[str] | None = None) -> DataFrame:
    """(dest, win, shard, shards, path, rows, run): the files that hold each window now; `rows` is the window's.

    `path` is relative to the target. With `days` (`20240101`), only windows that begin on one of them are looked at.
    """
    schema = "dest string, win string, shard long, shards long, path string, rows long, day string, run long"
    if not folder_exists(spark, f"{target}/{FILES}"):
        return spark.createDataFrame([], schema).drop("day")
    files = spark.read.schema(schema).parquet(f"{target}/{FILES}")
    if days is not None:
        files = files.where(F.col("day").isin(days))
    newest = files.groupBy(*PLACE).agg(F.max("run").alias("newest"))
    return files.join(newest, PLACE).where("run = newest").drop("day", "newest")


def read_published(spark: SparkSession, target: str, files: DataFrame | None = None) -> DataFrame:
    """(value, dest, win, path): the lines of published files, by default of all."""
    files = published_files(spark, target) if files is None else files
    names = [r["path"] for r in files.select("path").collect()]
    if not names:
        return spark.createDataFrame([], f"{STORED_DDL}, path string")
    with listed_in_blocks(spark):
        lines = spark.read.text([f"{target}/{n}" for n in names]).select("value", "_metadata.file_path")
    # The last two parts of the name; the path of the metadata is escaped as a URL.
    plain = F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))
    path = F.substring_index(plain, "/", -2)
    win = F.regexp_extract(path, "/output-(.*)-[0-9]+-of-[0-9]+[.]json$", 1)
    return lines.select("value", F.substring_index(path, "/", 1).alias("dest"), win.alias("win"), path.alias("path"))


def _changed(
    raw: _Raw, known: DataFrame | None, before: str, closed: str
) -> tuple[DataFrame | None, DataFrame]:
    """The raw rows to be published, None if there is no new file and no later time, and the names of all raw files."""
    listed = stage(raw.files(), "raw-files")
    fresh = listed if known is None else listed.join(known, "path", "left_anti")
    if closed == before and fresh.isEmpty():
        return None, listed
    hour = F.col("ends") <= closed[:_HOUR]
    new = [r["path"] for r in fresh.where(hour).select("path").collect()]
    end = window_end("win")
    rows = raw.rows(new).where(end <= closed)
    if known is not None and closed > before:
        again = listed.join(known, "path", "left_semi").where(hour & (F.col("ends") >= before[:_HOUR]))
        paths = [r["path"] for r in again.select("path").collect()]
        rows = rows.unionByName(raw.rows(paths).where((end > before) & (end <= closed)))
    return rows, listed.select("path")


def publish_windows(
    spark: SparkSession,
    source: str,
    target: str,
    closed_before: str,
    max_rows_per_file: int = MAX_ROWS_PER_FILE,
    **attach: int,
) -> DataFrame:
    """Publish the windows of `source` that end by `closed_before` (`20240101-000100`) under `target`.

    Returns the files of this run as `published_files` does; none if nothing is new. The time never goes back: a
    run with an earlier time than the last one uses the last one's. Windows larger than `max_rows_per_file` are
    cut into shards. One run at a time may work on a target.
    """
    last = _last_run(spark, target)
    if last >= 0:
        _finish(spark, target, last)
    with cleared(spark):
        made = _run(spark, source, target, last, closed_before, max_rows_per_file, **attach)
    if not made:
        return published_files(spark, target, [])
    if last >= 0:
        remove_paths(spark, [f"{target}/{folder}/run={last}" for folder in (KNOWN, RUNS)])
    return published_files(spark, target).where(F.col("run") == last + 1)


def _run(
    spark: SparkSession, source: str, target: str, last: int, closed_before: str, max_rows: int, **attach: int
) -> bool:
    """The run after `last`; False if there is nothing new to look at."""
    run, known, before = last + 1, None, ""
    if last >= 0:
        known = spark.read.schema("path string, closed string").parquet(f"{target}/{KNOWN}/run={last}")
        before = known.agg(F.max("closed")).first()[0] or ""
        known = known.where("path is not null").select("path")
    closed = max(closed_before, before)
    rows, listed = _changed(_Raw(spark, source), known, before, closed)
    if rows is None:
        return False
    rows = stage(rows, "raw-rows")
    windows = stage(rows.select(*PLACE).distinct(), "windows")
    plan = spark.createDataFrame([], PLAN_DDL)
    if not windows.isEmpty():
        days = [r["day"] for r in windows.select(F.substring("win", 1, 8).alias("day")).distinct().collect()]
        old = stage(published_files(spark, target, days).join(windows, PLACE, "left_semi"), "old-files")
        held = read_published(spark, target, old).select("value", *PLACE)
        plan = _write_aside(rows.unionByName(held), old, target, run, max_rows, **attach)
    state = listed.select("path", F.lit(closed).alias("closed")).unionByName(
        spark.createDataFrame([(None, closed)], "path string, closed string")
    )
    for table, folder in ((state, KNOWN), (plan, RUNS)):
        table.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{target}/{folder}/run={run}")
    _finish(spark, target, run)
    return True


def _write_aside(
    rows: DataFrame, old: DataFrame, target: str, run: int, max_rows: int, **attach: int
) -> DataFrame:
    """Write the windows' files into the attempt folder; returns the plan of the run."""
    spark = rows.sparkSession
    cut, tasks = sharded(rows, max_rows, **attach)
    name = F.concat("dest", F.lit("/output-"), "win", F.format_string("-%05d-of-%05d.json", "_shard", "_shards"))
    named = cut.select("value", name.alias("file"))
    attempt = f"{target}/{ATTEMPT}/run={run}"
    gathered = named.repartition(tasks, "file").sortWithinPartitions("file")
    gathered.write.mode("overwrite").options(
        partitionOverwriteMode="static", maxRecordsPerFile=0, **PLAIN_FILES
    ).partitionBy("file").text(attempt)
    # One row per file that was written: `.../file=<escaped name>/part-...`.
    found = stage(written_files(spark, attempt).select(F.col("path").alias("source")), "written")
    plain = F.replace(F.substring_index(F.substring_index("source", "/", -2), "/", 1), F.lit("+"), F.lit("%2B"))
    path = F.substring(F.url_decode(plain), len("file=") + 1, 1 << 20)
    files = found.select("source", path.alias("path"))
    part = lambda k: F.regexp_extract("path", "^(.*)/output-(.*)-([0-9]+)-of-([0-9]+)[.]json$", k)
    sizes = rows.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("rows"))
    put = files.select(
        F.lit(run).cast("long").alias("run"),
        F.substring(part(2), 1, 8).alias("day"),
        part(1).alias("dest"),
        part(2).alias("win"),
        part(3).cast("long").alias("shard"),
        part(4).cast("long").alias("shards"),
        "source",
        "path",
    ).join(sizes, PLACE, "left").withColumn("state", F.lit(_PUT))
    gone = old.join(files, "path", "left_anti").select(
        F.lit(run).cast("long").alias("run"),
        F.substring("win", 1, 8).alias("day"),
        *PLACE,
        "shard",
        "shards",
        F.lit(None).cast("string").alias("source"),
        "path",
        "rows",
        F.lit(_GONE).alias("state"),
    )
    names = [c.split()[0] for c in PLAN_DDL.split(", ")]
    return put.select(*names).unionByName(gone.select(*names))
