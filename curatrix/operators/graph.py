"""Relations between rows of one table: cycles, and orders that fit several sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def peeled(edges: DataFrame) -> DataFrame:
    """Edges (a, b) without nodes that lack a successor or a predecessor, taken off until none is left to take."""
    left = cut(edges.select("a", "b").filter("a is not null and b is not null").distinct())
    n = left.count()
    while n:
        ends = left.select(F.col("b").alias("x")).distinct(), left.select(F.col("a").alias("x")).distinct()
        left = cut(left.join(ends[0], F.col("a") == F.col("x"), "left_semi").join(ends[1], F.col("b") == F.col("x"), "left_semi"))
        if (m := left.count()) == n:
            break
        n = m
    return left


def _least(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, low): the least node from which a node is reached along (source, target), itself included."""
    low = cut(edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct().withColumn("low", F.col("node")))
    while True:
        sent = edges.join(low, F.col(source) == F.col("node")).groupBy(F.col(target).alias("to")).agg(F.min("low").alias("sent"))
        new = cut(low.join(sent, F.col("node") == F.col("to"), "left").select("node", F.least("low", "sent").alias("low"), (F.coalesce("sent", "low") < F.col("low")).alias("moved")))
        low = new.select("node", "low")
        if new.filter("moved").isEmpty():
            return low


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes of (a, b) that a path leads from back to themselves.

    What peeling leaves is coloured: a node takes the least node that reaches it; nodes that reach their colour
    back inside it are strongly connected to it, and are a cycle if there are two or an edge to itself. These
    are taken out and the rest is peeled and coloured again, until nothing is left. Repeated edges count once;
    nulls are no nodes. Rounds grow with the longest cycle, rows never beyond the edges.
    """
    left, out = peeled(edges), None
    while not left.isEmpty():
        colour = _least(left, "a", "b")
        c = lambda side: colour.select(F.col("node").alias(side), F.col("low").alias(f"c{side}"))
        inside = cut(left.join(c("a"), "a").join(c("b"), "b").filter("ca = cb"))
        # back along the edges from each colour's own node
        reach = cut(colour.filter("node = low").select("node", "low"))
        while True:
            more = inside.join(reach.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node"), F.col("ca").alias("low")).distinct().join(reach, ["node", "low"], "left_anti")
            more = cut(more)
            if more.isEmpty():
                break
            reach = cut(reach.unionAll(more))
        size = reach.groupBy("low").agg(F.count("*").alias("n"))
        own = left.filter("a = b").select(F.col("a").alias("node"))
        found = reach.join(size.filter("n > 1"), "low").select("node").unionAll(own.join(reach, "node", "left_semi")).distinct()
        out = found if out is None else out.unionAll(found)
        gone = reach.select(F.col("node").alias("x"))
        left = peeled(left.join(gone, F.col("a") == F.col("x"), "left_anti").join(gone, F.col("b") == F.col("x"), "left_anti"))
    return edges.select(F.col("a").alias("node")).limit(0) if out is None else out.distinct()
