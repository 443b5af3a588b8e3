"""The keys a stream has seen, as a table: duplicate flags without a state store or Python per row.

Each micro-batch combines its keys first and asks which of them were seen before. The keys lie in generations: one per
batch at first; when `FAN_IN` of about the same size stand at the end, they are merged into one. So a key is
written again only a few times, and there are few generations. Generations are cut into `BUCKETS` by a hash of
the key. A filter of fixed size (Bloom, `FILTER_BITS`) tells for most new keys that they are new; only the
buckets of the other keys are opened, and only these keys are joined.

A batch writes its keys, then its commit with the list of generations. A batch that is repeated starts from the commit
before it, so it flags its rows as it did the first time. The filter is made from the keys when a
stream starts; bits it has too many cost a look into a bucket and change nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators import duplicates
from tidemark.operators.duplicates import ENTITY_KEY
from tidemark.operators.groups import attach_facts, same_keys
from tidemark.session import cleared, matching_paths, remove_paths, stage

BUCKETS = 64
FILTER_BITS = 1 << 26
PROBES = 4
FAN_IN = 8
#: Generations up to this many keys count as equally small.
SMALL = 10_000


def _tier(rows: int, fan_in: int) -> int:
    """Generations of one tier differ in size by less than `fan_in` times."""
    tier = 0
    while rows > SMALL:
        rows //= fan_in
        tier += 1
    return tier


class SeenKeys:
    """Keys by generation under `path`. All keys of a stream have the same columns."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: list[str],
        buckets: int = BUCKETS,
        filter_bits: int = FILTER_BITS,
        fan_in: int = FAN_IN,
    ) -> None:
        if filter_bits < 64 or filter_bits & (filter_bits - 1):
            raise ValueError("the filter's size must be a power of two, 64 or more")
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.buckets, self.filter_bits, self.fan_in = buckets, filter_bits, fan_in
        self.filter: np.ndarray | None = None
        self.opened = 0  # buckets the last batch looked into

    def combined(self, rows: DataFrame) -> DataFrame:
        """(keys, _h, _bucket, _n): the keys of some rows, combined before the shuffle."""
        h = F.xxhash64(*self.keys)
        counted = rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
        bucket = F.pmod(F.shiftright(h, 40), F.lit(self.buckets)).cast("int")
        return counted.select(*self.keys, h.alias("_h"), bucket.alias("_bucket"), "_n")

    def seen_before(self, batch_id: int, combined: DataFrame) -> DataFrame:
        """Those of the keys that a batch before `batch_id` has added."""
        generations = self._generations(batch_id)
        self.opened = 0
        if not generations:
            return combined.limit(0)
        if self.filter is None:
            self._load_filter(generations)
        maybe = stage(self._maybe(combined), "maybe-seen")
        # At most as many numbers as there are buckets.
        wanted = [r["_bucket"] for r in maybe.select("_bucket").distinct().collect()]
        self.opened = len(wanted)
        if not wanted:
            return combined.limit(0)
        known = self._read(generations).where(F.col("_bucket").isin(wanted))
        known = known.select("_h", *[F.col(k).alias(f"_k_{k}") for k in self.keys])
        return maybe.join(known, (maybe["_h"] == known["_h"]) & same_keys(maybe, known, self.keys, "_k_"), "left_semi")

    def add(self, batch_id: int, new: DataFrame) -> None:
        """Add keys that were not seen before, and commit the batch."""
        before = self._generations(batch_id)
        own = (batch_id, batch_id, self._write(batch_id, batch_id, new.select(*self.keys, "_h", "_bucket")))
        generations = [*before, own]
        merged = self._merge(generations)
        self._set_bits(new)
        self._commit(batch_id, merged)
        # What this commit and the one before don't name can't be asked for any more.
        needed = {g[:2] for g in [*before, *merged]}
        found = matching_paths(self.spark, f"{self.path}/keys/gen=*")
        spans = {p: tuple(int(x) for x in p.rsplit("gen=", 1)[1].split("-")) for p in found}
        remove_paths(self.spark, [p for p, span in spans.items() if span not in needed])

    # -- generations

    def _folder(self, lo: int, hi: int) -> str:
        return f"{self.path}/keys/gen={lo}-{hi}"

    def _write(self, lo: int, hi: int, keys: DataFrame) -> int:
        """Write a generation, sorted by bucket; returns its number of keys."""
        folder = self._folder(lo, hi)
        writer = keys.repartition("_bucket").sortWithinPartitions("_bucket", "_h")
        writer = writer.write.mode("overwrite").option("partitionOverwriteMode", "static")
        # One file per bucket is worth it for merged generations only; the others have the bucket as a column.
        (writer.partitionBy("_bucket") if lo < hi else writer).parquet(folder)
        return self.spark.read.parquet(folder).count()

    def _read(self, generations: list[tuple[int, int, int]]) -> DataFrame:
        columns = [*self.keys, "_h", "_bucket"]
        parts = [
            self.spark.read.parquet(self._folder(lo, hi)).select(*columns)
            for lo, hi, rows in generations
            if rows
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _merge(self, generations: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Merge the generations at the end as long as `fan_in` of them are of one size."""
        while len(generations) >= self.fan_in:
            last = generations[-self.fan_in :]
            if max(_tier(g[2], self.fan_in) for g in last) > _tier(last[-1][2], self.fan_in):
                return generations
            lo, hi, rows = last[0][0], last[-1][1], sum(g[2] for g in last)
            if rows:
                self._write(lo, hi, self._read(last))
            generations = [*generations[: -self.fan_in], (lo, hi, rows)]
        return generations

    def _generations(self, batch_id: int) -> list[tuple[int, int, int]]:
        """Those of the newest commit before `batch_id`; commits end with the file of their write."""
        found = matching_paths(self.spark, f"{self.path}/commits/batch=*/_SUCCESS")
        done = [int(p.rsplit("/", 2)[1].removeprefix("batch=")) for p in found]
        last = max((b for b in done if b < batch_id), default=None)
        if last is None:
            return []
        text = self.spark.read.text(f"{self.path}/commits/batch={last}").first()["value"]
        return [tuple(g) for g in json.loads(text) if g[2]]

    def _commit(self, batch_id: int, generations: list[tuple[int, int, int]]) -> None:
        line = self.spark.createDataFrame([(json.dumps(generations),)], "value string")
        line.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").text(
            f"{self.path}/commits/batch={batch_id}"
        )
        old = [p for p in matching_paths(self.spark, f"{self.path}/commits/batch=*")]
        numbers = {p: int(p.rsplit("batch=", 1)[1]) for p in old}
        remove_paths(self.spark, [p for p, n in numbers.items() if n < batch_id - 1])

    # -- filter

    def _cells(self, hashes: DataFrame) -> DataFrame:
        """(cell, bits): the filter's words that some keys set, at most as many as the filter has."""
        places = [F.pmod(F.xxhash64("_h", F.lit(k)), F.lit(self.filter_bits)) for k in range(PROBES)]
        bits = hashes.select(F.explode(F.array(*places)).alias("place")).select(
            F.shiftright("place", 6).alias("cell"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")
        )
        return bits.groupBy("cell").agg(F.bit_or("bit").alias("bits"))

    def _load_filter(self, generations: list[tuple[int, int, int]]) -> None:
        self.filter = np.zeros(self.filter_bits // 64, np.int64)
        self._set_bits(self._read(generations))

    def _set_bits(self, keys: DataFrame) -> None:
        if self.filter is None:
            self.filter = np.zeros(self.filter_bits // 64, np.int64)
        cells = self._cells(keys.select("_h")).toArrow()
        self.filter[cells["cell"].to_numpy()] |= cells["bits"].to_numpy()

    def _maybe(self, combined: DataFrame) -> DataFrame:
        """The keys of which all bits are set."""
        held = self.spark.sparkContext.broadcast(self.filter)
        places = [F.pmod(F.xxhash64("_h", F.lit(k)), F.lit(self.filter_bits)).alias(f"_p{k}") for k in range(PROBES)]
        names = combined.columns

        def test(batches: Iterator) -> Iterator:
            import pyarrow as pa

            bits = held.value.view(np.uint64)
            for batch in batches:
                hit = np.ones(len(batch), bool)
                for k in range(PROBES):
                    place = batch.column(len(names) + k).to_numpy().astype(np.uint64)
                    hit &= ((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
                yield batch.select(names).filter(pa.array(hit))

        return combined.select(*names, *places).mapInArrow(test, combined.schema)


def flag_batch(
    seen: SeenKeys, rows: DataFrame, batch_id: int, order_by: str = "us", **attach: int
) -> DataFrame:
    """`is_duplicate` for the rows of a micro-batch: false on the first row of a key ever.

    Within the batch the earliest row by `order_by` is the first. The keys are added to `seen`, so each batch is
    flagged in turn, and again only to repeat the last one.
    """
    rows = stage(rows.select(*[c for c in rows.columns if c != "is_duplicate"]), "batch")
    combined = stage(seen.combined(rows), "batch-keys")
    old = stage(seen.seen_before(batch_id, combined), "seen-keys")
    fresh, some_old = combined, not old.isEmpty()
    if some_old:
        named = old.select(*[F.col(k).alias(f"_o_{k}") for k in seen.keys])
        fresh = combined.join(named, same_keys(combined, named, seen.keys, "_o_"), "left_anti")
    seen.add(batch_id, fresh)
    flagged = duplicates.flag_duplicates(rows, seen.keys, [order_by], **attach)
    if not some_old:
        return flagged
    known = attach_facts(flagged, old.select(*seen.keys, "_n"), seen.keys, "_n", **attach)
    columns = [c for c in flagged.columns if c != "is_duplicate"]
    return known.select(*columns, (F.col("is_duplicate") | F.col("_n").isNotNull()).alias("is_duplicate"))


def flag_stream(
    stream: DataFrame,
    path: str,
    keys: list[str] = ENTITY_KEY,
    order_by: str = "us",
    trigger: dict | None = None,
    **seen_options: int,
) -> StreamingQuery:
    """Flag a stream batch by batch: rows with `is_duplicate` under `<path>/rows/batch=<n>`, keys under `<path>/seen`.

    A batch that is repeated replaces its own rows.
    """
    spark = stream.sparkSession
    seen = SeenKeys(spark, f"{path}/seen", keys, **seen_options)

    def run(rows: DataFrame, batch_id: int) -> None:
        with cleared(spark):
            flagged = flag_batch(seen, rows, batch_id, order_by)
            flagged.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
                f"{path}/rows/batch={batch_id}"
            )

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
