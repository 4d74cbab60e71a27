"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of the ends of edges (a, b).

    In each round a node takes the least label among its own and its neighbours', and then that label's own label; rounds grow with the logarithm of
    a component's diameter on common graphs. A hub's edges are added up before they are shuffled.
    """
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = materialize(edges.select("a", "b").union(turned).where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = materialize(nodes.join(least, "node", "left").select("node", F.coalesce(F.least("node", "near"), "node").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.coalesce(F.least("label", "near"), "label").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(hooked.join(far, "label", "left").select("node", "old", F.coalesce(F.least("label", "next"), "label").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
