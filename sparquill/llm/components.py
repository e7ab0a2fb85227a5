"""Connected components by contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a long, b long); component is the smallest node reachable.

    In each round every node moves to the node of its closed neighbourhood that
    comes first in that round's pseudo-random order, and edges follow their
    ends; edges inside a node vanish. A constant fraction of nodes goes in each
    round, so there are about log(nodes) rounds, whatever the shape. No link or
    component passes through the driver. Self-links and repeats are fine.
    """
    left = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a is not null and b is not null").distinct())
    labels, turn = left.select("a").union(left.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("label")), 0
    old, left = (left,), left.filter("a <> b")
    while not left.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("o"), F.col(c).alias("n"))  # noqa: B023, E731
        both = left.union(left.select("b", "a"))
        moves = materialize(both.groupBy("a").agg(F.min(order("b")).alias("best")).select(F.col("a").alias("from"), F.least(F.col("best"), order("a"))["n"].alias("to")))
        labels = materialize(labels.join(moves, labels.label == moves["from"], "left").select("node", F.coalesce("to", "label").alias("label")))
        at_a, at_b = moves.toDF("a", "to_a"), moves.toDF("b", "to_b")
        left = materialize(
            left.join(at_a, "a").join(at_b, "b").filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        )
        release(*old, moves)  # labels and left of this round hold all that counts
        old = (left, labels)
        turn += 1
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
