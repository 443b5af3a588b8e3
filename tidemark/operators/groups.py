"""Bring facts about a group back to its rows, however unevenly the rows are spread."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

# A broadcast stays below both bounds; they are checked against the facts themselves.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000
# Largest groups treated one by one; any other group holds less than 1/10,000 of all rows.
HOT_GROUPS = 10_000


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    """Equality on all keys where NULL equals NULL, as in a grouping."""
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys]
    )


def attach_facts(
    rows: DataFrame,
    facts: DataFrame,
    keys: list[str],
    size: str,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_groups: int = HOT_GROUPS,
) -> DataFrame:
    """Left join of `rows` with `facts`, which has at most one row per `keys`.

    `size` names the column of `facts` with the number of rows in the group. The facts are
    written out once, so that they can be measured before a way is chosen:

    * few facts: they are broadcast and the rows are not shuffled at all;
    * many facts: the `hot_groups` largest groups are broadcast, which bounds the broadcast by
      construction, and their rows are spread by input task; all other rows meet their facts in a
      shuffled join whose groups are small by choice of the hot ones.
    """
    facts = stage(facts, "facts")
    values = [c for c in facts.columns if c not in keys]
    width = F.length(F.to_json(F.struct(*facts.columns)))
    if facts.count() <= broadcast_rows:
        if (facts.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES:
            small = facts.select(*[F.col(k).alias(f"_f_{k}") for k in keys], *values)
            joined = rows.join(F.broadcast(small), same_keys(rows, small, keys, "_f_"), "left")
            return joined.select(*[rows[c] for c in rows.columns], *[small[v] for v in values])

    largest = [F.desc(size), *keys]
    hot = stage(facts.orderBy(*largest).limit(hot_groups), "hot")
    widest = hot.agg(F.max(width)).first()[0] or 1
    if widest * hot_groups > BROADCAST_BYTES:
        hot = hot.orderBy(*largest).limit(BROADCAST_BYTES // widest)
    hot = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(hot), same_keys(rows, hot, keys, "_h_"), "left").select(
        *[rows[c] for c in rows.columns],
        hot["_hot"],
        # The task number is the same when a task is run again, unlike a random number.
        F.when(hot["_hot"].isNotNull(), 1 + F.spark_partition_id()).otherwise(0).alias("_spread"),
    )
    cold = facts.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        F.struct(*values).alias("_cold"),
        F.lit(0).alias("_c__spread"),
    )
    joined = marked.join(cold, same_keys(marked, cold, [*keys, "_spread"], "_c_"), "left")
    found = F.coalesce(marked["_hot"], cold["_cold"])
    return joined.select(
        *[marked[c] for c in rows.columns], *[found[v].alias(v) for v in values]
    )


def number_copies(df: DataFrame, label: str = "copy_no", chunk: int = 1_000_000) -> DataFrame:
    """Give equal rows the numbers 1, 2, … in `label`, so that every row can be told apart.

    Copies are counted before the shuffle, so a row with very many copies travels once per
    task; it is unfolded again in chunks that are spread over tasks.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    few = counted.filter(F.col("_n") <= chunk).select(
        *df.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias(label)
    )
    many = (
        counted.filter(F.col("_n") > chunk)
        .withColumn("_lo", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(chunk))))
        .repartition(*df.columns, "_lo")
        .select(
            *df.columns,
            F.explode(
                F.sequence(F.col("_lo"), F.least(F.col("_lo") + (chunk - 1), F.col("_n")))
            ).alias(label),
        )
    )
    return few.unionByName(many)
