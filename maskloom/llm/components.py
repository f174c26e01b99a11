"""Connected components by repeated contraction, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): the nodes of one component have one root, itself one of them.

    Each round sends every node to the least of its neighbours and itself, in an order drawn anew by hashing, and the
    edges along with it; edges within a node go. A constant share of the nodes is expected to go with each round,
    whatever the shape of the graph, and a round holds no node's neighbours together: minima are taken on the map side
    first, and joins are against one row per node.
    """
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("r"))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
        sent = stored(least.select("node", F.least(order("node"), "m")["r"].alias("r")), "sent")
        rounds.append(sent)
        ends = edges.join(sent.toDF("a", "ra"), "a").join(sent.toDF("b", "rb"), "b").filter("ra <> rb")
        edges = stored(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[0].toDF("node", "root")
    for sent in rounds[1:]:
        roots = roots.join(sent.toDF("root", "r"), "root", "left").select("node", F.coalesce("r", "root").alias("root"))
    return stored(roots, "roots")
