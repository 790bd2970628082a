"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another: root is the component's smallest node.

    ``edges`` has two columns of one orderable type; direction, repeats, self-loops and nulls do not matter (an edge
    with a null end is no edge). Every step hangs the neighbours of a node on the smallest of them. A minimum is
    aggregated before the shuffle, and the join that brings it back is an equi-join whose large side the adaptive skew
    join can split, so a node with very many neighbours is no group in one task. The number of rounds grows with the
    logarithm of the longest path, not with the path. Only three sums a round reach the driver.
    """
    first, second = edges.columns
    pairs = edges.select(F.col(first).alias("u"), F.col(second).alias("v")).where("u <> v")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(pairs)
    while state[0]:
        pairs = cut(_small_star(_large_star(pairs)))
        before, state = state, _state(pairs)
        if state == before:
            break
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(pairs: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.shiftright(mixed, 20)), F.sum(mixed.bitwiseAND(0xFFFFF))).first()
    return tuple(row)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node (u) and its smaller neighbours (v) are linked to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    others = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(others).distinct()
