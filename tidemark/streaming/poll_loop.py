"""Live polling of change tables with a progress table.

Every poll is one batch: its plan is written first, then its records, then its commit. A batch
that failed anywhere is repeated from the plan it had and replaces its own records, so each poll's
output appears exactly once. Plan and commit hold one row per table, which is all the driver ever
sees; change rows go from scan to files on the executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.functions.records import to_records
from tidemark.schema import (
    INITIAL_WATERMARK_LAG_SECONDS,
    WATERMARK_LAG_SECONDS,
    TableConfig,
)
from tidemark.session import matching_paths, remove_paths
from tidemark.sources.scan import change_feed_scan, fan_in, poll_scan_micros
from tidemark.sources.tables import scan_tables

SECOND = 1_000_000
# Commits that are put into one file, and that stay as they are.
FOLD = 256

PROGRESS_DDL = (
    "batch_id long, table_name string, scan_lo long, start long, prev_start long, target long, "
    "is_due boolean, rows long, next_start long, next_prev long, watermark long, "
    "active_at long, next_due long, state string"
)

# Change rows, with `table_name`, of the tables and ranges (name, lo, hi) that are due.
Scan = Callable[[list[tuple[str, int, int]]], DataFrame]


def each_table(read: Callable[[str, int, int], DataFrame], mode: str = "polling") -> Scan:
    """One scan per table, for tables of any kind; `read` gives the table of a name.

    `mode` is `polling` for change tables; anything else reads change feeds.
    """
    scan = poll_scan_micros if mode.lower() == "polling" else change_feed_scan

    def scan_all(due: list[tuple[str, int, int]]) -> DataFrame:
        return fan_in({name: scan(read(name, lo, hi), lo, hi) for name, lo, hi in due})

    return scan_all


def stored_tables(spark: SparkSession, root: str) -> Scan:
    """One scan of all tables stored under one root."""
    return lambda due: scan_tables(spark, root, due)


def now_micros() -> int:
    return time.time_ns() // 1000


class PollLoop:
    """Polls `tables` and writes change records under `root`.

    With `lookback` polls overlap by half the previous range; without it they are contiguous.
    `start_us` defaults to now: no history is read. `idle_timeout` is the quiet time in seconds
    after which a table's watermark follows the clock: 0 at once, None never.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: Sequence[TableConfig],
        scan: Scan,
        root: str,
        lookback: bool = True,
        start_us: int | None = None,
        idle_timeout: int | None = None,
    ) -> None:
        self.spark = spark
        self.tables = list(tables)
        self.scan = scan
        self.root = root.rstrip("/")
        self.lookback = lookback
        self.start_us = start_us
        self.idle_timeout = idle_timeout
        lag = WATERMARK_LAG_SECONDS if lookback else 0
        self.lag_us = lag * SECOND
        self.initial_lag_us = 0 if lookback else INITIAL_WATERMARK_LAG_SECONDS * SECOND

    @property
    def records_path(self) -> str:
        return f"{self.root}/records"

    def poll(self, batch_id: int, now_us: int | None = None) -> None:
        """Run one poll, or finish it if an earlier attempt did not."""
        if self._load("committed", batch_id) is not None:
            return
        plan = self._load("planned", batch_id)
        if plan is None:
            plan = self._plan(batch_id, now_micros() if now_us is None else now_us)
            self._save("planned", batch_id, plan)
        found = self._emit(batch_id, [row for row in plan if row["is_due"]])
        self._save("committed", batch_id, [self._advance(row, found) for row in plan])
        self._fold(batch_id)

    def start(self, trigger: str | None = None) -> StreamingQuery:
        """Poll on a tick stream, at the shortest interval of any table."""
        shortest = min(t.poll_interval for t in self.tables)
        ticks = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        return (
            ticks.writeStream.foreachBatch(lambda _, batch_id: self.poll(batch_id))
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(processingTime=trigger or f"{shortest} seconds")
            .start()
        )

    def records(self) -> DataFrame:
        """All records written so far, with their `batch_id`."""
        return self.spark.read.parquet(self.records_path).withColumnRenamed("batch", "batch_id")

    def progress(self) -> DataFrame:
        """Committed positions, one row per batch and table."""
        recent = self.spark.read.schema(PROGRESS_DDL).parquet(f"{self.root}/committed/*")
        last = self._folded()
        if last is None:
            return recent
        # Commits that were folded but not yet removed are read once.
        folded = self.spark.read.schema(PROGRESS_DDL).parquet(f"{self.root}/folded/*")
        return folded.unionByName(recent.where(F.col("batch_id") > last))

    def _folded(self) -> int | None:
        """The last batch whose commit was folded."""
        found = matching_paths(self.spark, f"{self.root}/folded/upto=*/_SUCCESS")
        return max((int(p.rsplit("/", 2)[1].removeprefix("upto=")) for p in found), default=None)

    def _fold(self, batch_id: int) -> None:
        """Put the commits of `FOLD` batches into one file, and remove their folders and those of their plans.

        The last `FOLD` batches are left as they are, so no batch that can be repeated is touched.
        """
        upto, last = batch_id - FOLD, self._folded()
        first = 0 if last is None else last + 1
        if upto - first + 1 < FOLD:
            return
        folders = [f"{self.root}/committed/batch={b}" for b in range(first, upto + 1)]
        commits = self.spark.read.schema(PROGRESS_DDL).parquet(*folders)
        commits.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{self.root}/folded/upto={upto}"
        )
        remove_paths(self.spark, [*folders, *[f"{self.root}/planned/batch={b}" for b in range(first, upto + 1)]])

    def last_commit(self) -> int | None:
        """Number of the newest poll that was committed."""
        found = matching_paths(self.spark, f"{self.root}/committed/batch=*/_SUCCESS")
        return max((int(p.rsplit("/", 2)[1].removeprefix("batch=")) for p in found), default=None)

    def lowest_watermark(self) -> int | None:
        """The watermark of the slowest table at the newest commit, in microseconds: windows that end by then are closed."""
        last = self.last_commit()
        return None if last is None else min(row["watermark"] for row in self._load("committed", last))

    def _plan(self, batch_id: int, now_us: int) -> list[dict]:
        last = self._load("committed", batch_id - 1) if batch_id > 0 else None
        if batch_id > 0 and last is None:
            raise ValueError(f"batch {batch_id} needs the commit of batch {batch_id - 1}")
        before = {row["table_name"]: row for row in last or []}
        first = now_us if self.start_us is None else self.start_us
        plan = []
        for table in self.tables:
            state = before.get(table.table_name) or {
                "next_start": first,
                "next_prev": first,
                "watermark": first - self.initial_lag_us,
                "active_at": now_us,
                "next_due": now_us,
            }
            start, prev = state["next_start"], state["next_prev"]
            is_due = state["next_due"] <= now_us and start < now_us
            waits = state["next_due"] > now_us
            plan.append(
                {
                    "batch_id": batch_id,
                    "table_name": table.table_name,
                    "scan_lo": (start + prev) // 2 if self.lookback else start,
                    "start": start,
                    "prev_start": prev,
                    "target": now_us,
                    "is_due": is_due,
                    "rows": 0,
                    "next_start": start,
                    "next_prev": prev,
                    "watermark": state["watermark"],
                    "active_at": state["active_at"],
                    "next_due": state["next_due"]
                    if waits
                    else now_us + table.poll_interval * SECOND,
                    "state": "planned",
                }
            )
        return plan

    def _emit(self, batch_id: int, due: list[dict]) -> dict[str, tuple[int, int]]:
        """Write the batch's records; rows and largest position per table, from what was written."""
        if not due:
            return {}
        changes = self.scan([(r["table_name"], r["scan_lo"], r["target"]) for r in due])
        # One row per table, as in the plan.
        starts = self.spark.createDataFrame(
            [(r["table_name"], r["start"]) for r in due], "table_name string, _start long"
        )
        changes = changes.join(F.broadcast(starts), "table_name")
        written = to_records(changes, start_us=F.col("_start")).drop("_start")
        path = f"{self.records_path}/batch={batch_id}"
        # Records that were written to the end are kept, as a reader may have seen them.
        wrote = None
        if not self._exists(f"{path}/_SUCCESS"):
            wrote = Observation()
            written = written.observe(wrote, F.count(F.lit(1)).alias("rows"))
            written.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        stats = (
            self.spark.read.schema(written.schema)
            .parquet(path)
            .groupBy("table_name")
            .agg(F.count(F.lit(1)).alias("rows"), F.max("us").alias("max_us"))
        )
        found = {r["table_name"]: (r["rows"], r["max_us"]) for r in stats.collect()}
        if wrote is not None and wrote.get["rows"] != sum(rows for rows, _ in found.values()):
            raise OSError(f"batch {batch_id}: {wrote.get['rows']} rows were written, {found} are there")
        return found

    def _advance(self, row: dict, found: dict[str, tuple[int, int]]) -> dict:
        """The committed form of a planned row."""
        done = {**row, "state": "committed"}
        if not row["is_due"]:
            return done
        rows, max_us = found.get(row["table_name"], (0, None))
        done["rows"] = rows
        if self.lookback:
            if rows:
                done["next_start"] = max(row["start"], max_us) + 1
                done["next_prev"] = row["start"]
        else:
            done["next_start"] = done["next_prev"] = row["target"]
        if rows:
            done["watermark"] = max(row["watermark"], max_us - self.lag_us)
            done["active_at"] = row["target"]
        elif self.idle_timeout is not None:
            if row["target"] - row["active_at"] >= self.idle_timeout * SECOND:
                done["watermark"] = max(row["watermark"], row["target"])
        return done

    def _save(self, kind: str, batch_id: int, rows: list[dict]) -> None:
        df = self.spark.createDataFrame(rows, PROGRESS_DDL)
        df.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{self.root}/{kind}/batch={batch_id}"
        )

    def _load(self, kind: str, batch_id: int) -> list[dict] | None:
        """Rows of a plan or commit; None if it was never finished."""
        path = f"{self.root}/{kind}/batch={batch_id}"
        if not self._exists(f"{path}/_SUCCESS"):
            return None
        rows = self.spark.read.schema(PROGRESS_DDL).parquet(path).collect()
        return [r.asDict() for r in rows]

    def _exists(self, path: str) -> bool:
        try:
            self.spark.read.format("binaryFile").load(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return False
            raise
        return True
