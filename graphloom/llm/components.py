"""Connected components by minimum labels and pointer jumping, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import drop, store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of a link: the smallest node it is connected with.

    Each round is two joins by key, whose hot keys Spark can split, and one
    partial minimum; the labels of a round are written to the shared folder.
    The number of rounds grows with the logarithm of the longest path.
    """
    both = store(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(b, a)).where("u <> v").distinct(), "links")
    labels = store(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "v"), "v").select("u", "label")
        offered = store(seen.union(labels.select("node", "label")).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("label")), "offered")
        roots = offered.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = store(offered.join(roots, "label").select("node", F.col("root").alias("label")), "labels")
        changed = jumped.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        drop(offered)
        drop(labels)
        labels = jumped
        if not changed:
            drop(both)
            return labels
