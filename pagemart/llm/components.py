"""Connected components of a graph given by its edges, with nothing on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemart.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the smallest node it can reach.

    Each round gives a node the smallest label among its neighbours, and then that label's own
    label, so a chain shortens by powers of two. Minima are taken before the shuffle too, so
    a hub with many neighbours costs one row per task. Rounds end when no label changes; each
    is written to the shared folder.
    """
    links = edges.select("a", "b").where("a <> b")
    links = written(links.union(links.select("b", "a")).distinct().toDF("node", "near"), "links")
    labels = written(links.groupBy("node").agg(F.least("node", F.min("near")).alias("label")), "labels")
    while True:
        near = links.join(labels.select(F.col("node").alias("near"), "label"), "near")
        near = near.groupBy("node").agg(F.min("label").alias("found"))
        nearer = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "found").alias("step")
        )
        jump = labels.select(F.col("node").alias("step"), F.col("label").alias("far"))
        found = nearer.join(jump, "step", "left").select(
            "node", "old", F.least("step", F.coalesce("far", "step")).alias("label")
        )
        found = written(found, "labels")
        labels = found.drop("old")
        if found.where("label < old").isEmpty():
            return labels
