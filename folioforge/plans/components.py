"""Connected components of an undirected graph by min-label exchange and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.plans.lineage import release, shared_table


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for each node of an edge; ``component`` is the least node of its component.

    Nulls on either side drop the edge; self loops give a component of their own; an empty edge table gives an empty
    result. Each round takes the least label among a node and its neighbours, then replaces it by that label's own
    label, so the rounds grow with the logarithm of the longest chain. Nothing is collected; labels are written to the
    shared folder after each round, which keeps the plan short and the job restartable after lost executors. No join
    is a broadcast: files of labels are small for what they hold, and each round would send them through the driver.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = shared_table(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    labels = shared_table(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), "component").hint("merge"), "v").select(F.col("u").alias("node"), "component")
        least = seen.union(labels.select("node", "component")).groupBy("node").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("__up"))
        stepped = least.join(jump.hint("merge"), "component", "left").select("node", F.least("component", "__up").alias("component"))
        was = labels.select("node", F.col("component").alias("__was"))
        new = shared_table(stepped.join(was.hint("merge"), "node").select("node", "component", (F.col("component") != F.col("__was")).alias("__moved")), "labels")
        release(labels)
        labels = new.select("node", "component")
        if new.where("__moved").isEmpty():
            release(both)
            return labels
