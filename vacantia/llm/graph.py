"""Connected components of an undirected edge table, in rounds of joins with checkpoints between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, component), the component being its smallest node.

    Every node takes the smallest label among its neighbours, then labels are jumped (the label
    of the label), so that chains halve each round; labels only ever fall, so the rounds end. A
    label that a whole component shares is looked up once a label, not once a node: its distinct
    values are joined, and the result goes back by a join that adaptive execution may split.
    Self-edges and repeated edges are allowed; no edges give no rows.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        nearer = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "m").alias("next"), "component")
        # jump: take over the label of one's label
        used = nearer.select("next").distinct()
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("further")).join(used, "next", "left_semi")
        new = cut(nearer.join(jump, "next").select("node", F.least("next", "further").alias("new"), "component"))
        changed = new.filter("new <> component").limit(1).count()
        labels = new.select("node", F.col("new").alias("component"))
        if not changed:
            return labels
