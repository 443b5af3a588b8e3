"""Changes replayed in the order in which they arrive, with Spark's own watermark dropping what comes too late."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage
from tidemark.streaming.windows import stream_window_counts

NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def replay_arrivals(
    arrivals: DataFrame, path: str, delay: str, seconds: int, event_time: str = "change_timestamp"
) -> tuple[DataFrame, DataFrame]:
    """Window counts of a stream whose batches are the values of `step`, in order, and what was dropped.

    The first table is that of `stream_window_counts`: windows that the watermark has closed. The second one has
    (step, dropped_groups) for each batch, from the progress that the query reports: how many windows of tables
    got rows after they were closed. Rows are combined by window before they are tested, so groups are counted.

    Every step is a batch of one streaming query that is started again, as a job is. Batches without data are switched off:
    they would move the watermark on between two steps.
    """
    spark = arrivals.sparkSession
    rows = stage(arrivals, "arrivals")
    steps = [r["step"] for r in rows.select("step").distinct().orderBy("step").collect()]
    before = spark.conf.get(NO_DATA, "true")
    spark.conf.set(NO_DATA, "false")
    dropped, out, schema = [], f"{path}/out", rows.drop("step").schema
    try:
        for step in steps:
            rows.where(F.col("step") == step).drop("step").write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{path}/in").withWatermark(event_time, delay)
            query = (
                stream_window_counts(stream, event_time, seconds)
                .writeStream.format("parquet")
                .option("path", out)
                .option("checkpointLocation", f"{path}/checkpoint")
                .outputMode("append")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
            reports = [json.loads(p.json)["stateOperators"] for p in query.recentProgress]
            dropped.append((step, sum(op["numRowsDroppedByWatermark"] for ops in reports for op in ops)))
    finally:
        spark.conf.set(NO_DATA, before)
    counts = "table_name string, win_start_us long, win_end_us long, rows long, min_us long, max_us long"
    kept = spark.read.schema(counts).parquet(out) if steps else spark.createDataFrame([], counts)
    return kept, spark.createDataFrame(dropped, "step long, dropped_groups long")
