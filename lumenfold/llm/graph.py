"""Connected components by contraction, on edges that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b -> node, root: for every node of an edge, one node of its component.

    Each round, a node points to the least of itself and its neighbours, pointers are followed once more, and
    edges are redrawn between what their ends point to; the rest have less than half the nodes. Minima are
    combined before they move, so a node with a third of all edges is no burden. Loops and repeats do no harm.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    roots = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        least = cut(least, "pointers")
        onward = least.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = cut(least.join(onward, "to").select("node", F.col("next").alias("to")), "pointers")
        if roots is None:
            roots = step.select("node", F.col("to").alias("root"))
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            roots = cut(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = cut(ends.where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
