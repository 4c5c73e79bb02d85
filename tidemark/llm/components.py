"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_hot, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of `edges` (a, b) is connected with.

    Each round takes the smallest label among neighbours and then the label's own label, so paths
    shorten quickly; a round is written to the shared folder.  Nodes with many edges and labels
    of many nodes are joined by broadcast.  Null ends and loops add nothing but their node.
    """
    some = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = stored(some.union(some.select("b", "a")).distinct().toDF("node", "other"), "edges")
    degrees = stored(both.groupBy("node").agg(F.count("*").alias("n")), "degrees")
    labels = stored(
        both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels"
    )
    while True:
        heard = (
            join_hot(both, labels, "node", degrees)
            .groupBy("other")
            .agg(F.min("label").alias("heard"))
        )
        near = labels.join(heard.withColumnRenamed("other", "node"), "node").select(
            "node", "label", F.least("label", "heard").alias("next")
        )
        near = stored(near, "labels")
        sizes = near.groupBy("next").agg(F.count("*").alias("n"))
        further = near.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        jumped = join_hot(near, further, "next", sizes).select("node", "label", "jump")
        jumped = stored(jumped, "labels")
        labels = jumped.select("node", F.col("jump").alias("label"))
        if jumped.where(F.col("jump") != F.col("label")).isEmpty():
            return labels
