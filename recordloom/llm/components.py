"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import cut, drop_cut


def connected(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node it is connected with) of the nodes of ``edges`` (a, b).

    Each round takes the smallest label of a node's neighbours and then the label of
    that label, so chains halve from round to round. All steps are equi-joins and
    aggregations that combine before they shuffle; the files of a round are deleted
    when the next one is written.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        least = cut(labels.join(near, "node").select("node", F.least("label", "other").alias("now"), "label"))
        up = least.select(F.col("node").alias("now"), F.col("now").alias("up"))
        after = cut(least.join(up, "now").select("node", F.least("now", "up").alias("label"), (F.least("now", "up") < F.col("label")).alias("moved")))
        drop_cut(labels, least)
        labels = after
        if after.where("moved").isEmpty():
            drop_cut(both)
            return after.select("node", "label")
