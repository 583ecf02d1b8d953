"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the least node of each component, for the nodes that have links.

    Each round hangs every node below its least neighbour, shortens the way by one more step, and replaces the ends of the links
    by what they hang below; links within one node go. So the links get few fast, also for long chains and for stars. Each
    round's tables are written to the shared folder; the driver only sees whether links are left.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = stored(ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("up")), "up")
        higher = least.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = stored(least.join(higher.hint("merge"), "up").select("node", "top"), "up")
        if labels is None:
            labels = up.select("node", F.col("top").alias("label"))
        else:
            moved = up.select(F.col("node").alias("label"), "top")
            labels = labels.join(moved.hint("merge"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        labels = stored(labels, "labels")
        first = edges.join(up.withColumnRenamed("node", "a").hint("merge"), "a").select(F.col("top").alias("x"), "b")
        second = first.join(up.withColumnRenamed("node", "b").hint("merge"), "b").select("x", F.col("top").alias("y"))
        edges = stored(second.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct(), "links")
        if not edges.limit(1).count():
            return labels
