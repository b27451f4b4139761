"""Connected components of a graph given by its edges, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit


def components(edges: DataFrame, held: kit.Durable) -> DataFrame:
    """node, label: the least node that each node of ``edges`` (a, b) is linked to, itself included.

    Each round takes the least label among a node and its neighbours, then jumps to that label's own label, so that the
    rounds grow with the logarithm of the longest path. Rounds are written, so plans stay short. Minima are aggregated
    before each shuffle, so a node with many neighbours loads no single task.
    """
    both = held.hold(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = held.hold(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        rounded = held.hold(least.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        if rounded.filter("old <> label").isEmpty():
            return rounded.select("node", "label")
        labels = rounded.select("node", "label")
