"""Connected components of a link table, by hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, landed

BROADCAST_NODES = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b longs): the smallest node of its component.

    Each round a node and its label take the smallest label next to the node;
    then labels are followed one step. Every round's labels are a table in the
    shared folder. Rounds grow with the logarithm of the component's size.
    """
    both = landed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = landed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        side = broadcast_if_small(labels, BROADCAST_NODES)
        of_a = side.select(F.col("node").alias("a"), F.col("label").alias("la"))
        of_b = side.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        said = both.join(of_a, "a").join(of_b, "b").filter("lb < la") \
            .select(F.explode(F.array("a", "la")).alias("node"), F.col("lb").alias("said")) \
            .groupBy("node").agg(F.min("said").alias("said"))
        said = landed(said, "said")
        if said.isEmpty():
            jumped = labels
        else:
            jumped = landed(labels.join(broadcast_if_small(said, BROADCAST_NODES), "node", "left")
                            .select("node", F.least("label", F.coalesce("said", "label")).alias("label")), "labels")
        side = broadcast_if_small(jumped, BROADCAST_NODES).select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = landed(jumped.join(side, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        if said.isEmpty() and after.join(broadcast_if_small(jumped, BROADCAST_NODES).withColumnRenamed("label", "was"), "node") \
                .filter("label != was").isEmpty():
            return after
        labels = after
