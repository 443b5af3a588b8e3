"""Duplicate flag and removal on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.duplicates import ENTITY_KEY
from tidemark.session import ROCKSDB

# Groups that the repeats of one input task are spread over.
SPREAD = 16


def mark_local_repeats(rows: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Add `_repeat`: true if the row is not the first of its key within its Arrow batch.

    This is the combine step before a shuffle by key. Only key and order columns are looked at;
    all others pass through untouched.
    """

    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            seen = batch.select(keys + order_by).to_pandas()
            repeat = seen.sort_values(order_by, kind="stable").duplicated(keys).sort_index()
            columns = [*batch.columns, pa.array(repeat.to_numpy(), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_repeat"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_repeat", T.BooleanType())])
    return rows.mapInArrow(mark, schema)


def flag_duplicates(
    stream: DataFrame,
    keys: list[str] = ENTITY_KEY,
    order_by: str = "us",
    ttl_ms: int | None = None,
) -> DataFrame:
    """Set `is_duplicate` on a stream: false on the first row of a key ever, then true.

    One boolean per key is kept, for ever unless `ttl_ms` is given. With it Spark keeps starting
    batches without data to expire state, so a query that is to end when its input does also
    needs `spark.sql.streaming.noDataMicroBatches.enabled=false`. Within a micro-batch the
    earliest row by `order_by` is the first.

    Rows that are no first of their key in their own Arrow batch are duplicates whatever the state
    says. They are grouped apart, by the task they come from, so that a key with very many rows
    sends only one row per Arrow batch to the task that holds its state.
    """
    from pyspark.sql.streaming import StatefulProcessor

    columns = [c for c in stream.columns if c != "is_duplicate"]
    schema = T.StructType(
        [*stream.select(*columns).schema.fields, T.StructField("is_duplicate", T.BooleanType())]
    )

    class FirstSeen(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getValueState("seen", "seen boolean", ttl_ms)

        def handleInputRows(self, key, rows, timerValues):
            from pyspark.sql import Row

            make, places, time = Row(*columns, "is_duplicate"), None, None
            repeats = key[-1] >= 0
            known = repeats or self.seen.exists()
            first = None
            for row in rows:
                if places is None:
                    # Found once per group: access by name searches the names for every value.
                    names = row.__fields__
                    places, time = [names.index(c) for c in columns], names.index(order_by)
                if not known:
                    if first is None:
                        first = row
                        continue
                    if row[time] < first[time]:
                        first, row = row, first
                yield make(*[row[i] for i in places], True)
            if first is not None:
                self.seen.update((True,))
                yield make(*[first[i] for i in places], False)

        def close(self) -> None:
            pass

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    task = F.spark_partition_id() * SPREAD + F.pmod(F.xxhash64(*keys), F.lit(SPREAD))
    group = {f"_g_{k}": F.when(~F.col("_repeat"), F.col(k)) for k in keys}
    group["_group"] = F.when(F.col("_repeat"), task).otherwise(-1)
    marked = mark_local_repeats(stream.select(*columns), keys, [order_by])
    return marked.withColumns(group).groupBy(*group).transformWithState(
        statefulProcessor=FirstSeen(),
        outputStructType=schema,
        outputMode="append",
        timeMode="none" if ttl_ms is None else "processingTime",
    )


def drop_duplicates(
    stream: DataFrame, keys: list[str], order_by: str = "us"
) -> DataFrame:
    """First row per key on a stream that has a watermark; keys are forgotten after its delay.

    Repeats within an Arrow batch are dropped before the shuffle, so a key with very many
    rows is no burden to the task that holds its state.
    """
    stream = mark_local_repeats(stream, keys, [order_by]).filter("not _repeat").drop("_repeat")
    return stream.dropDuplicatesWithinWatermark(keys)
