"""Connected components by label exchange with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Each round gives a node the smallest label among its own and its
    neighbours', then replaces a label by its own label.  Minima are combined
    before they are shuffled, and the joins have one row a node on one side,
    so that a node with very many neighbours can be split.  Every round is
    written to the shared folder, which also cuts the lineage.  Labels only fall,
    and a round that changes none is the last.
    """
    both = written(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if not both.limit(1).count():
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = written(step.join(hop, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")))
        moved = step.where("was <> label").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
