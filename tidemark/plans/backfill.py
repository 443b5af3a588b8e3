"""Read ranges of change tables in chunks that are noted down, so that a run can be stopped and gone on with.

The plan (which chunks there are, and which are read together) is written once. Each group of chunks is one scan of all
tables; its records replace what an earlier attempt left, and an entry in the ledger with the rows of each chunk
ends it. A run passes over the groups with an entry and reads the others again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.polls import chunk_index, range_chunks
from tidemark.session import folder_exists, mark_done, matching_paths

Scan = Callable[[list[tuple[str, int, int]]], DataFrame]
PLAN_DDL = "table_name string, chunk long, chunk_lo_us long, chunk_hi_us long, lo_us long, hi_us long, size_us long, part long"


class Backfill:
    """Backfill of (table, lo, hi) ranges under `path`; `scan` reads rows of such ranges.

    Chunks are `size_us` long as in `range_chunks`; `chunks_at_once` of each table are read together. An existing
    plan must be that of the same ranges, size and groups.
    """

    def __init__(
        self,
        spark: SparkSession,
        scan: Scan,
        path: str,
        ranges: list[tuple[str, int, int]],
        size_us: int,
        chunks_at_once: int = 16,
    ) -> None:
        self.spark, self.scan, self.path, self.size_us = spark, scan, path.rstrip("/"), size_us
        wanted = spark.createDataFrame(ranges, "table_name string, lo_us long, hi_us long")
        if len({name for name, _, _ in ranges}) < len(ranges):
            raise ValueError("a table can have one range only")
        chunks = range_chunks(wanted, size_us).join(wanted, "table_name").select(
            "table_name", "chunk", "chunk_lo_us", "chunk_hi_us", "lo_us", "hi_us",
            F.lit(size_us).cast("long").alias("size_us"),
            F.call_function("div", "chunk", F.lit(chunks_at_once)).cast("long").alias("part"),
        )
        if not folder_exists(spark, f"{self.path}/plan/_SUCCESS"):
            chunks.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.path}/plan")
        elif not (self.plan().exceptAll(chunks).isEmpty() and chunks.exceptAll(self.plan()).isEmpty()):
            raise ValueError(f"{self.path} has the plan of another backfill")

    def plan(self) -> DataFrame:
        return self.spark.read.schema(PLAN_DDL).parquet(f"{self.path}/plan")

    def finished(self) -> set[int]:
        found = matching_paths(self.spark, f"{self.path}/ledger/part=*/_DONE")
        return {int(p.rsplit("/", 2)[1].removeprefix("part=")) for p in found}

    def ledger(self) -> DataFrame:
        """(table_name, chunk, rows, part) of the finished chunks that have rows."""
        parts = sorted(self.finished())
        schema = "table_name string, chunk long, rows long, part long"
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/ledger").where(F.col("part").isin(parts))

    def rows(self) -> DataFrame:
        """The rows of all finished groups, with their `chunk`."""
        folders = [f"{self.path}/rows/part={p}" for p in sorted(self.finished())]
        if not folders:
            raise ValueError("no chunk is finished yet")
        return self.spark.read.parquet(*folders)

    def run(self, most: int | None = None) -> int:
        """Read groups that are not finished, at most `most` of them. Returns how many are left."""
        done = self.finished()
        parts = [r["part"] for r in self.plan().select("part").distinct().orderBy("part").collect()]
        left = [p for p in parts if p not in done]
        for part in left[:most]:
            self._read(part)
        return len(left[most:]) if most is not None else 0

    def _read(self, part: int) -> None:
        # One row per table.
        spans = self.plan().where(F.col("part") == part).groupBy("table_name", "lo_us", "hi_us").agg(
            F.min("chunk_lo_us").alias("from_us"), F.max("chunk_hi_us").alias("to_us")
        )
        spans = spans.collect()
        rows = self.scan([(r["table_name"], r["from_us"], r["to_us"]) for r in spans])
        whole = self.spark.createDataFrame(
            [(r["table_name"], r["lo_us"], r["hi_us"]) for r in spans], "_name string, _lo long, _hi long"
        )
        us = F.unix_micros("change_timestamp")
        index = chunk_index(us, F.col("_lo"), F.col("_hi"), self.size_us)
        numbered = rows.join(F.broadcast(whole), rows["table_name"] == whole["_name"]).withColumn("chunk", index)
        folder = f"{self.path}/rows/part={part}"
        self._write(numbered.drop("_name", "_lo", "_hi"), folder)
        counts = self.spark.read.parquet(folder).groupBy("table_name", "chunk").agg(F.count(F.lit(1)).alias("rows"))
        self._write(counts, f"{self.path}/ledger/part={part}")
        mark_done(self.spark, f"{self.path}/ledger/part={part}/_DONE")

    @staticmethod
    def _write(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
