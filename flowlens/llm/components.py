"""Connected components of a link table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.llm.tables import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a bigint, b bigint); component is the smallest
    node that can be reached.

    Every round a node takes the smallest label among its neighbours and itself, and then the label
    of that label (pointer jumping), which halves the way to it. Rounds end when no label changes;
    each is written to the shared folder, so the lineage stays short.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct())
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        lower = materialize(lower)
        jump = lower.select(F.col("node").alias("at"), F.col("component").alias("further"))
        after = materialize(
            lower.join(jump, lower["component"] == jump["at"]).select("node", "was", F.least("component", "further").alias("component"))
        )
        if after.where("was <> component").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
