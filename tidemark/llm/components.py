"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage


def _size(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them that changes whenever an edge does."""
    one = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(one)).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest vertex reachable from each vertex that has an edge.

    `edges` has the columns a and b in any order; loops and repeats are fine. Large-star and
    small-star steps alternate until nothing changes: each step hangs the neighbours of a vertex on
    the smallest of them, so the number of rounds grows with the logarithm of the longest path.
    Neighbours are combined before the shuffle and joined back, so a vertex with very many
    neighbours is never gathered in one task. Each round is written to the shared folder.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    pairs = stage(pairs.distinct(), "edges")
    before = _size(pairs)
    while before[0]:
        # Large star: every larger neighbour of a vertex goes to its smallest neighbour.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a vertex and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        pairs = stage(small.where("a <> b").distinct(), "edges")
        after = _size(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
