"""Connected components of large, shallow graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of the edges (a, b) can reach.

    Each round every node takes the least label among its neighbours, then its label's label. Rounds end when nothing changes; their number follows the logarithm of the longest path. Tables are written each round, so lost executors cost one round.
    Edges to self and repeated edges do no harm; an empty table gives no rows.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct()
    both = materialise(both)
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        near = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        near = materialise(near)
        roots = near.select(F.col("node").alias("root"), F.col("component").alias("above"))
        jumped = near.join(roots, near["component"] == roots["root"]).select("node", F.least("component", "above").alias("component"), (F.least("component", "above") != F.col("was")).alias("moved"))
        jumped = materialise(jumped)
        labels = jumped.select("node", "component")
        if jumped.filter("moved").isEmpty():
            return labels
