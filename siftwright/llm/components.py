"""Connected components of an edge table by repeated minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, release, written


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, comp): comp is the smallest node reachable. Nodes without an edge don't appear.

    Each round takes the least label among neighbours and then the label of that label, so that long chains
    shorten by half or more. Labels are written each round: a hot node is one row of labels, and the join with its
    many edges is one that adaptive execution may split.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    old = []
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "comp")
        lower = written(near.union(labels).groupBy("node").agg(F.min("comp").alias("comp")), "lower")
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = written(lower.join(jump, "comp", "left").select("node", F.least("comp", "up").alias("comp")), "labels")
        changed = new.join(labels.withColumnRenamed("comp", "was"), "node").where("comp <> was").limit(1).count()
        old += [labels, lower]
        labels = new
        if not changed:
            break
    for x in [both, *old]:
        drop(x)
    release(spark)
    return labels
