"""Connected components by star contraction: joins and minima, no group gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import materialize

#: Edges that one task of a round writes at most, about 16 bytes each.
TASK_EDGES = 100_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node reachable) of every node that an edge
    (a, b) names; loops and repeated edges are allowed. Every round replaces the
    edges of each node: the neighbours above it go to its smallest neighbour, then
    those below it do. Ends when no edge changes; each round is written to the
    shared folder, by as many tasks as its edges need."""
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Now a > b: every node is left with the neighbours below it.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        # A round never adds edges; it is written in few files, however many partitions it was shuffled into.
        now = materialize(
            small.select("a", F.col("m").alias("b"))
            .union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
            .coalesce(1 + mark[0] // TASK_EDGES), "edges"
        )
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)


def joined(group: DataFrame, more: DataFrame) -> DataFrame:
    """As `components`, for the edges that `group` (node, component) came from and those
    of `more` (a, b). What is connected so far goes in as one edge for each node, so the
    rounds start from there."""
    stars = group.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stars.unionByName(more.select("a", "b")))


def _mark(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart: their number and the sum of their hashes."""
    h = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())
