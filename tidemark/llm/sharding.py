"""Shards of bounded size by extendible hashing.

A document's key has 60 bits: 32 from the MD5 of its id, 28 from the MD5 of its text, so that rows which
share an id can still be parted. All documents begin in one bucket. A bucket whose texts
have more bytes than the limit splits on the next bit of the key, and only that one does; so a shard is
the shortest prefix of the key whose documents fit. The directory, a table of prefixes, is
found from sums over prefixes, not from documents.

A bucket of one key can't be split. One document larger than the limit is a shard of its own; equal rows
are dealt into numbered pages that fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, quoted
from tidemark.operators.groups import attach_facts
from tidemark.session import stage

KEY_BITS = 60
SHARD_BYTES = 256 << 20
MORE_BITS = 6  # looked at beyond the expected depth in one step


def key_of(id_col: str, text_col: str) -> Column:
    digest = lambda c, n: F.substring(F.md5(F.coalesce(c, F.lit("")).cast("binary")), 1, n)
    hexed = F.concat(
        digest(F.col(quoted(id_col)).cast("string"), 8), digest(F.col(quoted(text_col)), 7)
    )
    return F.conv(hexed, 16, 10).cast("long")


def _prefix(key: Column, bits: Column, of: int = KEY_BITS) -> Column:
    return F.call_function("shiftright", key, (F.lit(of) - bits).cast("int"))


def directory(keyed: DataFrame, limit: int) -> DataFrame:
    """(cell, cell_bits, depth): the depth of the shard that each cell of the key space belongs to.

    `keyed` has key and bytes. Cells are prefixes somewhat longer than shards are expected to be; those
    that are still too large are looked at again with more bits. Each step sums documents into cells
    once, then cells into every shorter prefix.
    """
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    lo, hi = 0, min(KEY_BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + MORE_BITS)
    rest, found = keyed, None
    while True:
        cells = rest.groupBy(_prefix(F.col("key"), F.lit(hi)).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most")
        )
        cells = stage(cells, "cells")
        level = F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("depth")
        wide = cells.select("cell", "bytes", "least", "most", level)
        wide = wide.withColumn("prefix", _prefix(F.col("cell"), F.col("depth"), hi))
        sums = wide.groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.max("most").alias("most")
        )
        final = sums.where((F.col("bytes") <= limit) | (F.col("least") == F.col("most")))
        leaf = wide.select("cell", "depth", "prefix").join(final.select("depth", "prefix"), ["depth", "prefix"])
        leaf = leaf.groupBy("cell").agg(F.min("depth").alias("depth"))
        leaf = stage(leaf.select("cell", F.lit(hi).alias("cell_bits"), "depth"), "leaves")
        found = leaf if found is None else found.unionByName(leaf)
        large = cells.join(leaf, "cell", "left_anti").select("cell")
        if hi == KEY_BITS or large.isEmpty():
            return found
        part = rest.withColumn("cell", _prefix(F.col("key"), F.lit(hi)))
        rest = stage(part.join(large, "cell", "left_semi").select("key", "bytes"), "large")
        lo, hi = hi + 1, min(KEY_BITS, hi + 12)


def assign(
    docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns of `docs` and key, n_bytes, depth, shard, page.

    `shard` is the prefix as a text of zeros and ones, empty if everything fits one shard. `page` is 0
    except for equal rows that don't fit together. NULL ids and texts count as empty; an empty table gives no
    rows. Where `docs` has a column of such a name, the new one is named `key_`, ...
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    names = new_columns(docs)
    inner = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    by = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    size = F.octet_length(F.coalesce(F.col(by[text_col]), F.lit(""))).cast("long")
    keyed = inner.withColumns({"key": key_of(by[id_col], by[text_col]), "n_bytes": size})
    leaves = directory(stage(keyed.select("key", F.col("n_bytes").alias("bytes")), "keys"), limit)
    bits = sorted(r[0] for r in leaves.select("cell_bits").distinct().collect())
    placed = keyed.withColumn("depth", F.lit(None).cast("int"))
    for b in bits:
        here = leaves.where(F.col("cell_bits") == b).select(F.col("cell").alias("cell_at"), F.col("depth").alias("cell_depth"))
        at = _prefix(F.col("key"), F.lit(b))
        placed = placed.join(here, at == F.col("cell_at"), "left")
        placed = placed.withColumn("depth", F.coalesce("depth", "cell_depth")).drop("cell_at", "cell_depth")
    bin_text = F.lpad(F.bin(_prefix(F.col("key"), F.col("depth"))), F.col("depth"), F.lit("0"))
    placed = placed.withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(bin_text))
    # Rows of one key that don't fit: only these are numbered.
    many = stage(
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b"), F.max("n_bytes").alias("m"))
        .where((F.col("n") > 1) & (F.col("b") > limit))
        .select("key", "n", F.greatest(F.lit(1), F.floor(limit / F.col("m"))).alias("page_rows")),
        "pages",
    )
    out = [*by.values(), "key", "n_bytes", "depth", "shard", "page"]
    if many.isEmpty():
        return placed.withColumn("page", F.lit(0).cast("long")).select(*out).toDF(*docs.columns, *names)
    known = attach_facts(placed, many, ["key"], "n")
    alone = known.where(F.col("n").isNull()).withColumn("page", F.lit(0).cast("long"))
    # A row's number: the rows of its key in tasks before its own, and its place within the task. The rows are written
    # first, so that a task's number is the same whenever it is looked at.
    crowd = stage(known.where(F.col("n").isNotNull()), "crowd").withColumn("task", F.spark_partition_id())
    counts = crowd.groupBy("key", "task").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("key", "task", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("ahead"), "rows")
    numbered = attach_facts(crowd, ahead, ["key", "task"], "rows")
    own = F.row_number().over(Window.partitionBy("key", "task").orderBy("n_bytes")) - 1
    numbered = numbered.withColumn("page", F.floor((F.col("ahead") + own) / F.col("page_rows")).cast("long"))
    return alone.select(*out).unionByName(numbered.select(*out)).toDF(*docs.columns, *names)


def new_columns(docs: DataFrame) -> list[str]:
    """The names of key, n_bytes, depth, shard and page beside the columns of `docs`."""
    return [fresh(docs, name) for name in ("key", "n_bytes", "depth", "shard", "page")]


def write(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write `docs` as Parquet, one folder `shard=<prefix>/page=<n>` per shard; the root is `shard=all`.

    Every shard is written by one task, which holds no more than the shards it writes.
    """
    key, n_bytes, depth, shard, page = new_columns(docs)
    placed = assign(docs, limit, id_col, text_col)
    name = F.when(F.col(depth) == 0, "all").otherwise(F.col(shard))
    out = placed.withColumn(shard, name).drop(key, n_bytes, depth)
    # The prefix keeps its zeros as text.
    out.repartition(shard, page).write.partitionBy(shard, page).parquet(path)
