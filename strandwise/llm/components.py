"""Connected components by smallest labels with pointer jumping; tables in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b): label is the smallest node reachable.

    Each round takes the smallest label among neighbours (summed before the shuffle) and then the
    label of that label, so paths shorten by more than half. A round is staged, so lineage stays
    short, and the round before it is deleted; only counts of rows reach the driver. Self-links are
    no edges; repeated edges are one; without edges there are no nodes.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    n = both.count()
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels", n)
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(heard, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        step = near.join(jump, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", "further").alias("label"))
        done = stage(step, "labels", n)
        unstage(labels)
        if not done.where("old <> label").limit(1).count():
            unstage(both)
            return done.drop("old")
        labels = done.drop("old")
        labels.staged_at = done.staged_at
