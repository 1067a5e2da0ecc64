"""Connected components by spreading the smallest label, with jumps over labels, so that long chains take few turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, join_hot, materialize


def components(edges: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(node, component) of edges(a, b): the smallest node reachable. Labels stay distributed; each turn is cut into a table.

    A node with most of the edges and a label that most nodes have are looked up by join_hot(), so no task gets them
    whole; up to `most` labels are broadcast instead, and a turn is one shuffle. A turn's tables are deleted once the next one is written.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    links = both.count()
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count("*").alias("degree")).withColumnRenamed("a", "node"), "labels", links)
    nodes = labels.count()
    while nodes <= most:
        own = labels.select("node", "label")
        of = lambda name: F.broadcast(own.alias(name))
        heard = both.alias("e").join(of("x"), F.col("e.b") == F.col("x.node")).groupBy("e.a").agg(F.min("x.label").alias("heard"))
        near = heard.join(of("y"), F.col("a") == F.col("y.node")).select(F.col("a").alias("at"), F.col("y.label").alias("was"), F.least("y.label", "heard").alias("to"))
        after = near.join(of("z"), F.col("to") == F.col("z.node")).select(F.col("at").alias("node"), "was", F.least("to", "z.label").alias("label"))
        after = materialize(after, "labels", nodes)
        discard(labels)
        labels = after
        if after.where("label != was").isEmpty():
            discard(both)
            return after.select("node", F.col("label").alias("component"))

    while True:
        heard = join_hot(both, labels.withColumnRenamed("node", "b"), "b", "degree", links).groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(heard.withColumnRenamed("a", "node"), "node").select("node", "degree", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        near = materialize(near, "near-labels")
        jump = near.groupBy("label").agg(F.count("*").alias("users")).join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label")
        jump = materialize(jump, "jumps")
        after = join_hot(near, jump, "label", "users", nodes).select("node", "degree", "was", F.least("label", "further").alias("label"))
        after = materialize(after, "labels")
        discard(labels, near, jump)
        labels = after
        if after.where("label != was").isEmpty():
            discard(both)
            return after.select("node", F.col("label").alias("component"))
