"""Connected components of an edge table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node that each node of the edges can reach.

    Every round a node takes the smallest label among its neighbours', then labels are followed one step (pointer
    jumping), so long chains shrink by half; rounds go on until nothing changes. Labels are written out each round and
    those of the round before deleted; minima combine before the shuffle, so a node with very many edges is no hot spot.
    """
    scratch = Scratch(edges.sparkSession)
    both = scratch.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "cc-edges")
    labels = scratch.table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "cc-labels-0")
    rounds = 0
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "low").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("beyond"))
        moved = lower.join(jump, F.col("next") == F.col("at"), "left").select("node", "component", F.least("next", "beyond").alias("next"))
        rounds += 1
        moved = scratch.table(moved, f"cc-labels-{rounds}")
        scratch.drop(f"cc-labels-{rounds - 1}")
        labels = moved.select("node", F.col("next").alias("component"))
        if not moved.where("next < component").limit(1).count():
            break
    scratch.drop_all(but=(f"cc-labels-{rounds}",))
    return labels
