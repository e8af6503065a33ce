"""Connected components: of an edge table, as joins and aggregations, and of links in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import common


class Forest:
    """Union-find over positions, for whole arrays of links at a time."""

    def __init__(self, size: int) -> None:
        self.parent = np.arange(size)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        parent = self.parent
        while len(left):
            a, b = parent[left], parent[right]
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            if len(left):
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                while True:
                    above = parent[parent]
                    if np.array_equal(above, parent):
                        break
                    parent[:] = above


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _lowest(edges: DataFrame) -> DataFrame:
    """The lowest neighbour of every left end, itself included."""
    return edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))


def star_components(edges: DataFrame, name: str) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges(a, b)``, of longs.

    Alternates two rounds until nothing changes: every node hands its larger neighbours, then its
    smaller ones, to the smallest of its neighbourhood. Each round is a table in the shared folder;
    only its row count and a checksum come to the driver. Edges never outnumber their start.
    """

    def mark(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = common.staged(_oriented(edges), name)
    before, seen = None, mark(now)
    while seen[0] and seen != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # As tables, these sides bring no partitioning that would tie a hub's edges to one task.
        large = (
            both.join(common.staged(_lowest(both), f"{name}-low"), F.col("a") == F.col("n"))
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        large = common.staged(_oriented(large), name)
        low = common.staged(_lowest(large), f"{name}-low")
        small = large.join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(low.select(F.col("n").alias("a"), F.col("low").alias("b")))
        now = common.staged(_oriented(small), name)
        before, seen = seen, mark(now)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
