"""Change tables as day-partitioned Parquet: `<root>/table_name=<name>/change_date=<day>/`."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import CHANGE_COLUMNS, CHANGE_DDL, FEED_TIMESTAMP, PARTITION_DAY
from tidemark.session import folder_names

EPOCH = date(1970, 1, 1)
DAY_US = 86_400_000_000


def table_path(root: str, table_name: str) -> str:
    return f"{root.rstrip('/')}/table_name={table_name}"


def table_schema() -> T.StructType:
    """Columns as stored, the day partition last."""
    return T.StructType.fromDDL(f"{CHANGE_DDL}, {PARTITION_DAY} date")


def create_tables(spark: SparkSession, root: str, table_names: list[str]) -> None:
    """Make the change tables that are not there yet; those that are stay as they are."""
    empty = spark.createDataFrame([], table_schema())
    for name in table_names:
        empty.write.mode("ignore").partitionBy(PARTITION_DAY).parquet(table_path(root, name))


def append_changes(changes: DataFrame, root: str) -> None:
    """Append rows carrying a `table_name` to their tables.

    No shuffle: each task writes the days it holds. Rows arrive roughly in time order, so a
    task meets few days, and a day that holds most rows is still written by many tasks.
    """
    (
        changes.select(
            *CHANGE_COLUMNS,
            "table_name",
            F.to_date("change_timestamp").alias(PARTITION_DAY),
        )
        .write.mode("append")
        .partitionBy("table_name", PARTITION_DAY)
        .parquet(root)
    )


def parse_change_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split NDJSON rows (`value`, `table_name`) into changes to append and lines to report."""
    schema = T.StructType.fromDDL(f"{CHANGE_DDL}, _corrupt string")
    parsed = lines.withColumn(
        "row",
        F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}),
    )
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    good = parsed.filter(~bad).select(*[f"row.{c}" for c in CHANGE_COLUMNS], "table_name")
    return good, parsed.filter(bad).select("table_name", "value")


def _day(us: int) -> date:
    return EPOCH + timedelta(days=us // DAY_US)


def _days(lo_us: int, hi_us: int) -> str:
    """Pattern of the day folders from `lo_us` to `hi_us`: whole years and months, then single days."""
    day, last = _day(lo_us), _day(max(lo_us, hi_us - 1))
    parts = []
    while day <= last:
        year_end = date(day.year, 12, 31)
        month_end = date(day.year + day.month // 12, day.month % 12 + 1, 1) - timedelta(days=1)
        if (day.month, day.day) == (1, 1) and year_end <= last:
            parts.append(f"{day.year:04d}-*")
            day = year_end
        elif day.day == 1 and month_end <= last:
            parts.append(f"{day.year:04d}-{day.month:02d}-*")
            day = month_end
        else:
            parts.append(day.isoformat())
        if day == date.max:
            break
        day += timedelta(days=1)
    return f"{PARTITION_DAY}={{{','.join(parts)}}}"


def require_tables(spark: SparkSession, root: str, table_names: Iterable[str]) -> None:
    """Raise unless the root and every table are there: a missing table is no quiet table."""
    present = folder_names(spark, root)
    missing = sorted(n for n in table_names if f"table_name={n}" not in present)
    if missing:
        raise FileNotFoundError(f"no table {', '.join(missing)} under {root}")


def _read_pattern(
    spark: SparkSession, root: str, pattern: str, schema: T.StructType
) -> DataFrame:
    """The days of a pattern; tables are known to exist, days without rows have no folder."""
    try:
        return spark.read.schema(schema).option("basePath", root).parquet(f"{root}/{pattern}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(
    spark: SparkSession,
    root: str,
    table_name: str,
    lo_us: int | None = None,
    hi_us: int | None = None,
) -> DataFrame:
    """The stored table. Given a range, only the days it touches are listed, not all there are."""
    require_tables(spark, root, [table_name])
    path = table_path(root, table_name)
    if lo_us is None or hi_us is None:
        return spark.read.schema(table_schema()).parquet(path)
    return _read_pattern(spark, path, _days(lo_us, hi_us), table_schema())


def _any_of(conditions: list[Column]) -> Column:
    """`OR` as a balanced tree, so that its depth grows with the logarithm of their number."""
    while len(conditions) > 1:
        pairs = zip(conditions[::2], [*conditions[1::2], None])
        conditions = [a if b is None else a | b for a, b in pairs]
    return conditions[0]


def scan_tables(spark: SparkSession, root: str, polls: list[tuple[str, int, int]]) -> DataFrame:
    """Change rows of many stored tables, each over its own range (name, lo, hi), in one scan.

    One listing and one scan serve any number of tables; a table that isn't there is an error. Tables that
    touch the same days share one condition, which prunes their days; the widest range is pushed down
    to the files, and the ranges, one row per table, are broadcast for the exact bounds.
    """
    root = root.rstrip("/")
    require_tables(spark, root, [name for name, _, _ in polls])
    first, last = min(lo for _, lo, _ in polls), max(hi for _, _, hi in polls)
    names = ",".join(name for name, _, _ in polls)
    schema = T.StructType(table_schema().fields + [T.StructField("table_name", T.StringType())])
    rows = _read_pattern(spark, root, f"table_name={{{names}}}/{_days(first, last)}", schema)
    rows = rows.filter(
        (F.col("change_timestamp") >= F.timestamp_micros(F.lit(first)))
        & (F.col("change_timestamp") < F.timestamp_micros(F.lit(last)))
    )
    same_days: dict[tuple[date, date], list[str]] = {}
    for name, lo, hi in polls:
        same_days.setdefault((_day(lo), _day(max(lo, hi - 1))), []).append(name)
    of_tables = [
        F.col("table_name").isin(own) & F.col(PARTITION_DAY).between(*days)
        for days, own in same_days.items()
    ]
    rows = rows.filter(_any_of(of_tables))
    ranges = spark.createDataFrame(polls, "_name string, _lo long, _hi long")
    us = F.unix_micros("change_timestamp")
    own = (rows["table_name"] == ranges["_name"]) & (us >= ranges["_lo"]) & (us < ranges["_hi"])
    return rows.join(F.broadcast(ranges), own).select(*CHANGE_COLUMNS, "table_name")


def write_feed(feed: DataFrame, root: str, name: str) -> None:
    """Append rows of a change feed, with columns of its own, by the day of their time."""
    day = F.to_date(FEED_TIMESTAMP).alias(PARTITION_DAY)
    feed.select("*", day).write.mode("append").partitionBy(PARTITION_DAY).parquet(table_path(root, name))


class StoredFeeds:
    """Change feeds stored under one root, each with columns of its own.

    The schema of a feed is looked up once, in its newest day, and kept: columns that are added later are seen by the next
    start. A feed stored by day is listed for the days of a range only; one that is not, as a whole.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._known: dict[str, tuple[T.StructType, bool]] = {}

    def _look_up(self, name: str) -> tuple[T.StructType, bool]:
        if name not in self._known:
            require_tables(self.spark, self.root, [name])
            path = table_path(self.root, name)
            days = sorted(n for n in folder_names(self.spark, path) if n.startswith(f"{PARTITION_DAY}="))
            schema = self.spark.read.parquet(f"{path}/{days[-1]}" if days else path).schema
            if days:
                schema = T.StructType([*schema.fields, T.StructField(PARTITION_DAY, T.DateType())])
            self._known[name] = schema, bool(days)
        return self._known[name]

    def read(self, name: str, lo_us: int, hi_us: int) -> DataFrame:
        """The feed's own columns; rows of the days of the range if it is stored by day, of all days if not."""
        schema, by_day = self._look_up(name)
        path = table_path(self.root, name)
        if not by_day:
            return self.spark.read.schema(schema).parquet(path)
        return _read_pattern(self.spark, path, _days(lo_us, hi_us), schema).drop(PARTITION_DAY)


def stream_table(
    spark: SparkSession,
    root: str,
    table_name: str,
    delay: str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The table as a stream; `delay` gives it a watermark of its own.

    Set the watermark here, per table and before any union: Spark then keeps the slowest
    table's watermark for the whole query.
    """
    reader = spark.readStream.schema(table_schema())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(table_path(root, table_name)).withColumn(
        "table_name", F.lit(table_name)
    )
    return stream.withWatermark("change_timestamp", delay) if delay else stream
