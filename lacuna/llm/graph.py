"""Connected components of a table of links, label by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.storage import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``: the smallest node that can be reached.

    Each round a node takes the smallest label among its neighbours', then the label of
    its label, so labels run along chains in doubling steps. Nulls and loops are left
    out. Rounds are written to the shared folder: the plan does not grow, and a lost
    executor costs its part of one round. Nothing is gathered but a count.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = written(pairs.union(pairs.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "near").alias("new"))
        of_label = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        jumped = stepped.join(of_label, "new", "left").select("node", F.least("new", "far").alias("component"), (F.least("new", "far") < F.col("component")).alias("moved"))
        done = written(jumped, "labels")
        labels = done.select("node", "component")
        if not done.filter("moved").limit(1).count():
            return labels
